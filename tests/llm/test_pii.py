import math
import random
import re
import time
from collections import Counter, defaultdict

from pathloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checks(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if checks(k, m.group())]


def brute(texts):
    """Spans of every text by the definitions, over all (entity, term) pairs of the corpus."""
    key = lambda k, v: (k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
    stem = lambda t: t[: max(1, min(5, len(t) - 2))] + "*"
    shape = lambda t: "[number]" if re.fullmatch("[0-9]+", t) else "[code]" if re.search("[0-9]", t) else "[word]"

    def terms(text, spans):
        hidden = {i for _, s, e in spans for i in range(s, e)}
        return [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c.group().lower(), m.group())) for m in re.finditer(pii.WORD, text) if not hidden & set(range(m.start(), m.end()))]

    n_t, n_ct, n_c, seen = Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        spans = base(text)
        n_t.update(re.sub("[A-Z]", lambda c: c.group().lower(), m) for m in re.findall(pii.WORD, text))
        words, counted = terms(text, spans), defaultdict(set)
        for k, s, e in sorted(spans, key=lambda x: x[1:]):
            at = sum(1 for w in words if w[0] < s)
            near = list(range(max(0, at - 8), min(len(words), at + 8)))
            c = key(k, text[s:e])
            for i in near:
                if i not in counted[c]:
                    n_ct[c, words[i][2]] += 1
                    n_c[c] += 1
                    seen[c, words[i][2]].add(tuple(words[j][2] for j in near))
            counted[c].update(near)
    total = sum(n_t.values())

    def tells(ct, t, c):
        ic = -math.log2(n_c[c] / total)
        return ct / t >= 0.5 and ic > 0 and 1 + math.log2(ct / t) / ic >= 0.5

    told = {}
    for (c, t), n in n_ct.items():
        if len(seen[c, t]) >= 3 and tells(n, n_t[t], c):
            told[c, t] = ""
            for form in (stem, shape):
                ct, every = sum(m for (d, u), m in n_ct.items() if d == c and form(u) == form(t)), sum(m for u, m in n_t.items() if form(u) == form(t))
                if not tells(ct, every, c):
                    told[c, t] = form(t)
                    break
    out = []
    for text in texts:
        spans = base(text)
        mine = {key(k, text[s:e]) for k, s, e in spans}
        out.append([f"{k}:{s}:{e}" for k, s, e in spans] + [f"term:{s}:{e}" for s, e, t in terms(text, spans) if any((c, t) in told for c in mine)])
    return out, told


def corpus():
    rng = random.Random(3)
    common = [a + b for a in "ab cd ef gh ij kl mn".split() for b in "er ing tion ly".split()]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [some(60) for _ in range(60)]
    # A name and a codeword that always stand by one address; a firm by two; a word by everything.
    for i in range(8):
        texts.append(f"{some(20)} Ulrike Zabrovsky mail u.zab@firm.example {some(15)}. {some(30)} Zabrovsky again {some(4)}")
        texts.append(f"{some(20)} call +49 (30) 5550-1234 for Projekt X77Q {some(20)} mail u.zab@firm.example {some(30)}")
        texts += [f"{some(20)} mail x{i}-{j}@firm.example {some(20)}" for j in range(4)]
    texts += [f"{some(5)} one two three a@b.cc four five"] * 20
    texts += ["", "1.2.3.4 1.2.3.256 01.2.3.4.5.6.7.8 999.1.1.1.1", "a@b.c_d@e.f x@y@z.w @q.r %@-.-", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111110", "+1 (017) 555-7713 +1234567 +123456789012345 +12 345 678 901 234 567 +1( )2", "é 😀 mail ü.x@exämple.de z@d.example 😀 10.0.0.1"]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    want, told = brute(texts)
    hidden = {t for _, t in told}
    assert {"zabrovsky", "ulrike", "projekt", "x77q"} <= hidden and not {"mail", "one", "four"} & hidden
    df = spark.createDataFrame([(i, t, "clash", "c") for i, t in enumerate(texts)] + [(900, None, "c", "c"), (0, texts[0], "c", "c")], "doc_id long, text string, spans string, k1 string")
    rows = pii.sanitise(df, "text").select("doc_id", "k1", "sanitised", pii.digest(pii.F.col("spans")).alias("s")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2 and got[900].s == "" and got[900].sanitised == ""
    assert [got[i].s for i in range(len(texts))] == [",".join(w) for w in want]
    at = got[60].sanitised
    assert "Zabrovsky" not in at and "u.zab" not in at and "[EMAIL]" in at
    assert all(got[i].sanitised == texts[i] for i in range(60))


def test_forms_that_disclose_are_not_used():
    texts = corpus()
    _, told = brute(texts)
    assert {told[c, t] for c, t in told if t == "zabrovsky"} == {"[word]"}


def test_patterns_as_defined():
    rng = random.Random(8)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "b", "@", ".", "-", "_", "+", " ", "(", "1", "12", "255", "300", "@b.c", "4111111111111111", "é", "\n"]) for _ in range(rng.randrange(1, 25)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.found(text)] == base(text), text


def test_copies_disclose_nothing_and_empty_table(spark):
    text = "alpha beta gamma unique words near copy@x.example and more of these"
    df = spark.createDataFrame([(i, text) for i in range(50)] + [(100, "nothing to see")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert all(len(rows[i].spans) == 1 for i in range(50)) and rows[100].spans == []
    assert pii.sanitise(df.limit(0)).count() == 0


def test_hostile_texts_take_linear_time():
    began = time.time()
    for piece in ("a", "1", "1.", "1 ", "+1", "+1(", "a@", "@a", "@a.b", "a@b.c", "a@b.", ".", "1-1", "é", "+(", "a1@"):
        pii.found(piece * (1_000_000 // len(piece)))
        list(pii.windows_of(piece * (200_000 // len(piece)) + " x@y.zz"))
    assert time.time() - began < 60

"""Queries without SQL form against slow, plain second versions on a small fixture: no numpy arrays, no Arrow, loops only."""

import math
import random
import re
import zlib
from html import unescape
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from pathloom.llm import html, langid, quality, registry, toxicity

MASK = 2**64 - 1
WORDS = {"en": "the of and in that with for this from was".split(), "de": "der die und ein nicht mit für auf das von".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    d = tmp_path_factory.mktemp("plain")
    docs, labels = [], []
    for i in range(70):
        lang, bad, toxic = rng.choice(["en", "de"]), rng.random() < 0.4, rng.random() < 0.4
        lines = [(" | " if bad else " ").join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "tion"]) for _ in range(rng.choice([3, 9]))).capitalize() + "." for _ in range(rng.choice([1, 2, 4]))]
        if toxic:
            lines[0] += " you idiot"
        docs.append((i, "\n".join(lines), lang))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(100, None, "en"), (101, "", None), (102, "12 34", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, labels


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def grams(text, orders, bits):
    """Bins of a text's n-grams, by string operations."""
    x = " " + " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split()) + " "
    if not x.strip():
        x = " "
    mix = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
    out = []
    for n in orders:
        for at in range(len(x) - n + 1):
            h = n
            for t in range(n):
                h = (h + ord(x[at + t]) * mix[t]) & MASK
                h ^= h >> 31
            out.append((h * 0x94D049BB133111EB & MASK) >> (64 - bits))
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def test_toxicity(spark, folder):
    path, docs, labels = folder
    y_of = {i: t for i, _, t in labels}
    train = [(i, t or "") for i, t, _ in docs if i in y_of and crc(i, 4) != 2]
    h = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _ in train], "i long").select("i", toxicity.F.xxhash64(toxicity.F.lit(23), "i").alias("h")).collect()}
    train.sort(key=lambda r: h[r[0]])
    sets = [sorted(set(grams(t, toxicity.ORDERS, toxicity.BITS))) for _, t in train]
    y = [y_of[i] for i, _ in train]

    def ratios(sets, y):
        n = {c: y.count(c) for c in (0, 1)}
        out = {}
        for g in {g for s in sets for g in s}:
            logs = {}
            for c in (0, 1):
                a = toxicity.SMOOTH * n[c] / len(y)
                logs[c] = math.log((sum(g in s for s, v in zip(sets, y, strict=True) if v == c) + a) / (n[c] + a))
            out[g] = logs[1] - logs[0]
        return out

    def vector(s, ratio):
        v = {g: ratio[g] for g in s if g in ratio}
        norm = math.sqrt(sum(x * x for x in v.values()) + 1e-12)
        return {g: x / norm for g, x in v.items()}

    def weight(z, n):
        return 0.0 if abs(z) <= toxicity.L1 else (math.copysign(toxicity.L1, z) - z) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)

    def learn(sets, y, ratio):
        z, n, zb, nb = {}, {}, 0.0, 0.0
        rng = np.random.default_rng(5)
        for _ in range(toxicity.EPOCHS):
            for i in rng.permutation(len(sets)).tolist():
                v = vector(sets[i], ratio)
                w = {g: weight(z.get(g, 0.0), n.get(g, 0.0)) for g in v}
                b = -zb * toxicity.ALPHA / (toxicity.BETA + math.sqrt(nb))
                g0 = sigmoid(sum(w[g] * x for g, x in v.items()) + b) - y[i]
                for g, x in v.items():
                    step = g0 * x
                    z[g] = z.get(g, 0.0) + step - (math.sqrt(n.get(g, 0.0) + step * step) - math.sqrt(n.get(g, 0.0))) / toxicity.ALPHA * w[g]
                    n[g] = n.get(g, 0.0) + step * step
                nb2 = nb + g0 * g0
                zb += g0 - (math.sqrt(nb2) - math.sqrt(nb)) / toxicity.ALPHA * b
                nb = nb2
        return {g: weight(z[g], n[g]) for g in z}, -zb * toxicity.ALPHA / (toxicity.BETA + math.sqrt(nb))

    inner = [i for i in range(len(y)) if i % 5]
    outer = [i for i in range(len(y)) if i % 5 == 0]
    ratio = ratios([sets[i] for i in inner], [y[i] for i in inner])
    w, b = learn([sets[i] for i in inner], [y[i] for i in inner], ratio)
    raw = [sum(w.get(g, 0.0) * x for g, x in vector(sets[i], ratio).items()) + b for i in outer]
    # The curve again, by small gradient steps on the same objective.
    slope, offset = 1.0, 0.0
    for _ in range(60_000):
        r = [sigmoid(slope * m + offset) - y[i] for m, i in zip(raw, outer, strict=True)]
        ga, gb = sum(x * m for x, m in zip(r, raw, strict=True)) + 1e-3 * (slope - 1), sum(r) + 1e-3 * offset
        slope, offset = slope - 0.004 * ga, offset - 0.004 * gb
        if abs(ga) + abs(gb) < 1e-9:
            break
    ratio = ratios(sets, y)
    w, b = learn(sets, y, ratio)
    got = {r.doc_id: r for r in registry.QUERIES["op7_toxicity"](spark, path).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        v = vector(sorted(set(grams(t or "", toxicity.ORDERS, toxicity.BITS))), ratio)
        want = sigmoid(slope * (sum(w.get(g, 0.0) * x for g, x in v.items()) + b) + offset)
        assert abs(got[i].score - want) < 5e-3, (i, got[i].score, want)
        assert got[i].held_out == (crc(i, 4) == 2) and got[i].predicted == int(got[i].score >= 0.3)


def test_language(spark, folder):
    path, docs, _ = folder
    train = [(t, lang) for i, t, lang in docs if t is not None and lang is not None and crc(i, 5) != 0]
    total = len(train)

    def counts(t):
        found = grams(t, langid.ORDERS, langid.BITS) if any(c.isalpha() for c in t) else []
        return {g: 1 + math.log(found.count(g)) for g in set(found)}

    features = [counts(t) for t, _ in train]
    df = {}
    for f in features:
        for g in f:
            df[g] = df.get(g, 0) + 1
    idf = lambda g: math.log((1 + total) / (1 + df.get(g, 0))) + 1
    langs = sorted({lang for _, lang in train})

    def unit(f):
        v = {g: x * idf(g) for g, x in f.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    rows = [(unit(f), langs.index(lang)) for f, (_, lang) in zip(features, train, strict=True) if f]
    rows.sort(key=lambda r: (len(r[0]), r[1], float(np.sum(np.array([r[0][g] for g in sorted(r[0])])))))
    held, kept = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    z, n = {}, {}

    def weight(g, k):
        zz, nn = z.get((g, k), 0.0), n.get((g, k), 0.0)
        return 0.0 if abs(zz) <= langid.L1 else -(zz - math.copysign(langid.L1, zz)) / ((langid.BETA + math.sqrt(nn)) / langid.ALPHA + langid.L2)

    def logits(v):
        return [sum(x * weight(g, k) for g, x in v.items()) + weight("bias", k) for k in range(len(langs))]

    rng = np.random.default_rng(5)
    for _ in range(langid.EPOCHS):
        for i in rng.permutation(len(kept)):
            v, y = kept[i]
            s = logits(v)
            e = [math.exp(x - max(s)) for x in s]
            step = {}
            for k in range(len(langs)):
                p = e[k] / sum(e) - (k == y)
                for g, x in [*v.items(), ("bias", 1.0)]:
                    step[g, k] = (p * x, weight(g, k))
            for key, (d, w) in step.items():
                nn = n.get(key, 0.0)
                z[key] = z.get(key, 0.0) + d - (math.sqrt(nn + d * d) - math.sqrt(nn)) / langid.ALPHA * w
                n[key] = nn + d * d

    def loss(t):
        out = 0.0
        for v, y in held:
            s = [x / t for x in logits(v)]
            out += math.log(sum(math.exp(x - max(s)) for x in s)) + max(s) - s[y]
        return out

    t = min((math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 60) for i in range(61)), key=loss)
    got = {r.doc_id: r for r in registry.QUERIES["op6_language_id"](spark, path).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        f = counts(text or "")
        if not f:
            assert (got[i].lang_pred, got[i].score) == ("und", 1.0)
            continue
        s = [x / t for x in logits(unit(f))]
        e = [math.exp(x - max(s)) for x in s]
        assert got[i].lang_pred == langs[e.index(max(e))] and abs(got[i].score - max(e) / sum(e)) < 5e-3
        assert got[i].held_out == (crc(i, 5) == 0)


def line_features(lines, i):
    """The features of one line by themselves, character by character."""

    def kind(c):
        return 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"()-" else 0

    line = lines[i]
    out = [math.log1p(len(line)), math.log1p(len(line.split()))]
    out += [sum(kind(c) == k for c in line) / max(1, len(line)) for k in range(6)]
    words = line.split()
    if not words:
        return out + [0.0] * 9
    n = len(words)
    out += [sum(map(len, words)) / n / 10, len(set(words)) / n, sum(words[j] == words[j + 1] for j in range(n - 1)) / n, sum(len(w) == 1 for w in words) / n, sum(len(w) in (2, 3) for w in words) / n, math.log1p(max(map(len, words))) / 3]
    return out + [float(line.rstrip()[-1] in ".!?"), float(line[0].isupper()), float(any(line == x for x in lines[:i]))]


def chain(text):
    lines = text.split("\n")
    own = [line_features(lines, i) for i in range(len(lines))]
    none = [0.0] * len(own[0])
    rows = [own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(lines) else none) + [float(i == 0), float(i + 1 == len(lines)), 1.0] for i in range(len(lines))]
    return rows, [len(x) + 1.0 for x in lines]


def enumerated(rows, w, trans):
    """Log partition function and P(good) of each line, over all labellings."""
    odds = [sum(a * b for a, b in zip(r, w, strict=True)) for r in rows]
    total, good = 0.0, [0.0] * len(rows)
    for y in product((0, 1), repeat=len(rows)):
        p = math.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(trans[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good = [g + p * v for g, v in zip(good, y, strict=True)]
    return math.log(total), [g / total for g in good], odds


def test_quality(spark, folder):
    """The document score from enumerated marginals; and the training's gradient from differences of the enumerated likelihood."""
    path, docs, labels = folder
    model = quality.fit(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")))
    got = {r.doc_id: r for r in registry.QUERIES["op5_line_crf_quality"](spark, path).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        rows, weight = chain(text or "")
        scaled = [[(x - m) / s for x, m, s in zip(r, model["mean"], model["scale"], strict=True)] for r in rows]
        _, good, _ = enumerated(scaled, model["w"], model["trans"])
        q = min(max(sum(g * k for g, k in zip(good, weight, strict=True)) / sum(weight), 1e-6), 1 - 1e-6)
        want = sigmoid(model["a"] * math.log(q / (1 - q)) + model["b"])
        assert abs(got[i].score - want) < 1e-6
        assert got[i].held_out == (crc(i, 3) == 1) and got[i].predicted == int(got[i].score >= 0.5)


def test_quality_training_follows_the_likelihood(monkeypatch):
    """One step of the optimiser moves every weight by RATE in the direction of the enumerated likelihood's slope."""
    monkeypatch.setattr(quality, "STEPS", 1)
    rng = np.random.default_rng(6)
    y = [1.0, 0.0, 1.0, 0.0, 0.0]
    x = [rng.normal(size=(n, 3)).astype(np.float32) for n in (4, 1, 3, 2, 5)]
    w, trans = quality.train(x, np.array(y))

    def likelihood(w, trans):
        out = 0.0
        for rows, label in zip(x, y, strict=True):
            z, _, odds = enumerated(rows.tolist(), w, trans)
            out += sum(odds) * label + trans[int(label)][int(label)] * (len(rows) - 1) - z
        return out

    zero, base = [0.0] * 3, [[0.0, 0.0], [0.0, 0.0]]
    for k in range(3):
        up, down = ([d * (j == k) for j in range(3)] for d in (1e-4, -1e-4))
        assert np.sign(w[k]) == np.sign(likelihood(up, base) - likelihood(down, base))
    for i, j in product((0, 1), repeat=2):
        up, down = ([[d * ((a, b) == (i, j)) for b in (0, 1)] for a in (0, 1)] for d in (1e-4, -1e-4))
        assert np.sign(trans[i, j]) == np.sign(likelihood(zero, up) - likelihood(zero, down))


def test_quality_training_reaches_the_optimum(monkeypatch):
    """After training, no small change of any weight raises the enumerated, penalised likelihood noticeably."""
    monkeypatch.setattr(quality, "STEPS", 3000)
    rng = np.random.default_rng(7)
    y = (rng.random(12) < 0.5).astype(float)
    x = [(rng.normal(size=(n, 2)) + 0.5 * label).astype(np.float32) for n, label in zip([1, 2, 3, 4, 2, 3, 1, 4, 3, 2, 2, 3], y, strict=True)]
    w, trans = quality.train(x, y)
    lines = sum(map(len, x))

    def value(p):
        wt, tr = list(p[:2]), [list(p[2:4]), list(p[4:6])]
        out = 0.0
        for rows, label in zip(x, y, strict=True):
            z, _, odds = enumerated(rows.tolist(), wt, tr)
            out += sum(odds) * label + tr[int(label)][int(label)] * (len(rows) - 1) - z
        return out / lines - quality.DECAY / 2 * sum(v * v for v in p)

    p = [*w, *trans.ravel()]
    for k in range(6):
        slope = (value([v + 1e-4 * (j == k) for j, v in enumerate(p)]) - value([v - 1e-4 * (j == k) for j, v in enumerate(p)])) / 2e-4
        assert abs(slope) < 2e-3


class Plain(HTMLParser):
    """Blocks by the standard library's parser, for well-nested pages; names by whole words."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.parts, self.stack, self.linked = [], [], [], 0

    def flush(self):
        said = " ".join("".join(self.parts).split())
        if said:
            names = [s[0] for s in self.stack]
            kind = "pre" if "pre" in names else "heading" if any(re.fullmatch("h[1-6]", n) for n in names) else ""
            self.out.append(html.Block(said, self.linked, *[any(s[i] for s in self.stack) for i in (1, 2, 3)], "article" in names or "main" in names, "form" in names, kind))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in html.BLOCK:
            self.flush()
            if tag == "p" and self.stack and "p" in [s[0] for s in self.stack]:
                while self.stack and "p" in [s[0] for s in self.stack]:
                    self.stack.pop()
        if tag in html.VOID:
            return
        inside = any(s[0] in ("article", "main") for s in self.stack) or tag in ("article", "main")
        self.stack.append((tag, *plain_shut(tag, {k: v or "" for k, v in attrs}, inside)))

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        if tag in [s[0] for s in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in html.RAW):
            self.parts.append(data)
            if "a" in [s[0] for s in self.stack]:
                self.linked += len("".join(data.split()))

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))


def plain_shut(tag, attrs, inside):
    """Tag, attributes and role; names that say it as a whole; names that only hold a word that says it."""
    if tag in html.BOILER or tag == "header" and not inside:
        return True, False, False
    if tag in ("html", "body", "article", "main"):
        return False, False, False
    style = re.sub(" ", "", attrs.get("style", "").lower())
    barred = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or any(r in html.ROLES for r in attrs.get("role", "").lower().split())
    whole = part = False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in re.sub("([a-z])([A-Z])", r"\1-\2", name).replace("_", "-").split("-") if w]
        says = lambda w: w in html.NAMED or w == "header" and not inside
        if any(w in html.ASIDE for w in words):
            continue
        if says(name.lower()) or words and any(map(says, words)) and all(says(w) or w in html.PLACES for w in words):
            whole = True
            break
        part = part or any(map(says, words))
    return barred, whole, part


def plain_judged(found, names):
    """Pass one, block by block."""
    heavy = lambda b: b.linked / max(1, len(b.text.replace(" ", ""))) > 0.35 and len(b.text.replace(" ", "")) - b.linked < 160
    out = lambda b, size: b.barred or names and b.named or names and b.hinted and size < 40 or heavy(b)
    share, words, stops = {}, 0, 0
    for i, b in enumerate(found):
        ws = b.text.lower().split()
        n = sum(w in html.STOP_WORDS or w.strip(".,;:!?()\"'*#%&$") in html.STOP_WORDS for w in ws)
        share[i] = n / len(ws)
        if not (b.barred or names and b.named or heavy(b)) and html.length(b.text) >= 40:
            words, stops = words + len(ws), stops + n
    labels = []
    for i, b in enumerate(found):
        size = html.length(b.text)
        if out(b, size):
            label = -1
        elif b.kind == "pre":
            label = 0
        elif size < 40:
            label = -1 if not b.article and re.match(r"©|\(c\) ", b.text) else 0
        elif stops < 0.1 * words:
            label = int(size >= 80)
        elif b.article:
            label = int(share[i] >= 0.12)
        else:
            label = 1 if size >= 160 and share[i] >= 0.25 else 0 if share[i] >= 0.12 else -1
        labels.append(label)
    return labels


def plain_labelled(found):
    """Both passes and the three ways out where no block is good."""
    first = plain_judged(found, True)
    for labels, names in ((first, True), ([1 if x == 0 and html.length(b.text) >= 40 else x for x, b in zip(first, found, strict=True)], True), (plain_judged(found, False), False)):
        out = plain_settled(found, labels, names)
        if 1 in out:
            return out
    own = lambda b: len(b.text.replace(" ", "")) - b.linked
    heavy = lambda b: b.linked > 0.35 * max(1, own(b) + b.linked) and own(b) < 160
    for stays in (lambda b: not (b.barred or b.named or b.hinted or heavy(b)), lambda b: not (b.barred or heavy(b)), lambda b: not b.barred and own(b) >= 20):
        if any(map(stays, found)):
            return [1 if stays(b) else -1 for b in found]
    return out


def plain_settled(found, labels, names=True):
    """Pass two by looking at every other block."""
    out = []
    for i, label in enumerate(labels):
        if label == 0:
            best = {}
            for side, others in (("l", range(i - 1, -1, -1)), ("r", range(i + 1, len(found)))):
                for j in others:
                    if found[i].article and not found[j].article:
                        break
                    if labels[j] and not (found[i].article and (found[j].barred or names and found[j].named)):
                        best[side] = (labels[j], sum(len(found[k].text) for k in range(min(i, j) + 1, max(i, j))))
                        break
            if found[i].article:
                label = 1 if not best or max(b[0] for b in best.values()) > 0 else -1
            elif found[i].kind == "heading" and "r" in best:
                label = best["r"][0]
            elif best:
                label = min((b[1], s == "r", b[0]) for s, b in best.items())[2] if len({b[0] for b in best.values()}) > 1 else next(iter(best.values()))[0]
        out.append(label)
    return out


def test_pages(spark, tmp_path):
    """Every page of the driver's tables and pages of random elements, by the second version."""
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice("the of and in town was valley people written history xyzzy &amp; &eacute;t&eacute; &#8364;".split()) for _ in range(n))

    def element(depth):
        tag = rng.choice(["p", "p", "div", "section", "article", "aside", "nav", "ul", "h2", "header", "footer", "form", "pre"])
        mark = rng.choice(["", "", "", ' class="ad"', ' class="share-price"', ' id="social-impact"', ' class="siteFooter"', ' id="comments-list"', ' class="entry-header big"', ' style="overflow:hidden"', ' hidden', ' role="navigation"', ' data-id="menu"', " aria-hidden=false"])
        inner = "".join(element(depth + 1) for _ in range(rng.randrange(4))) if depth < 3 and tag not in ("p", "h2", "pre") else rng.choice(["", "<a href='x'>" + sentence(rng.choice([2, 12])) + "</a> "]) + sentence(rng.choice([0, 3, 15, 60])) + rng.choice(["", "<br>" + sentence(4), "<b>" + sentence(3) + "</b>"])
        return f"<{tag}{mark}>{inner}</{tag}>"

    pages = [(i, f"u{i}", "<html><head><title>T</title><style>p{}</style></head><body>" + "".join(element(0) for _ in range(5)) + "<script>var a='<p>x</p>'</script></body></html>") for i in range(400)]
    pages += [(1000 + r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op10_html_blocks"](spark, str(tmp_path)).collect()}
    texts = 0
    for i, url, page in pages:
        parser = Plain()
        parser.feed(page or "")
        parser.close()
        parser.flush()
        found = parser.out
        words = lambda inside, f=found: sum(len(b.text) - b.linked for b in f if b.form == inside and not b.barred and not b.named)
        if words(True) <= words(False):
            found = [b._replace(barred=b.barred or b.form) for b in found]
        assert found == html.blocks(page or ""), (i, page)
        want = "\n".join(b.text for b, label in zip(found, plain_labelled(found), strict=True) if label > 0)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))
        texts += bool(want)
    assert texts > 60

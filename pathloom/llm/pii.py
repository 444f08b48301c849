"""Information-theoretic sanitisation of personal data.

Base entities (e-mail and IP addresses, card and phone numbers) are found by pattern and always hidden. What may still
give them away are the terms around them, and how strongly, the corpus itself tells:

* Windows of WINDOW terms on both sides of every entity are gathered over all documents. With n(c) terms in windows of
  entity c, n(t) occurrences of term t in the corpus, n(c, t) of them in windows of c, and N terms in all, the entity's
  information is IC(c) = -log2(n(c) / N), and what t tells of it is PMI(c; t) = log2(n(c, t) N / (n(c) n(t))).
* A term discloses an entity if it stands by it in SUPPORT different windows at least, PMI(c; t) >= DISCLOSURE * IC(c),
  and a share of POSTERIOR of all its occurrences is by the entity. Copies of a text multiply both sides of the share and
  add no window, so groups of copies disclose nothing that one text wouldn't.
* In documents that hold the entity, every occurrence of a disclosing term is generalised to the first of its general
  forms (its beginning, then its kind) which does not disclose the entity itself, by the same counts; if all do, it is
  removed. A document without a base entity stays as it is.

Only windows, counts and disclosing terms are shuffled, never texts or pairs of a group: windows grow with the
entities, counts are summed in every task first, and documents are known by two hashes of their text. Terms are runs of
characters other than ASCII punctuation, blanks and controls, A-Z in lower case; those that overlap a base entity are
no terms.

Whole texts are searched, in linear time. A null text is the empty one (no spans, sanitised empty); repeated rows and
copies each get their own result; an empty table gives none; columns of any other name pass, those called sanitised
or spans are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import scope, slices, small, written

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, DISCLOSURE, POSTERIOR = 8, 3, 0.5, 0.5
#: Letters of a term's beginning at most, and what it loses at least.
STEM, TAIL = 5, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts where a run of digits does: from inside a run it would end, or fail, in the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: Anything but ASCII controls, blanks and punctuation; Java and Python read it alike.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each @ with a domain back to the start of its local part, but not into the one before."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def found(text: str) -> list[tuple[int, int, int]]:
    """Base entities as (kind number, start, end) in code points, by kind, then start."""
    out = [(0, *x) for x in emails(text)]
    # int() of a few characters only: leading zeros are dropped first.
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches covered by base entities, (start, end, kind) with the first listed kind of each, in order."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1]), min(kind, out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def terms(text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where terms stand that overlap no covered stretch."""
    out, i = [], 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while i < len(covered) and covered[i][1] <= start:
            i += 1
        if i == len(covered) or covered[i][0] >= end:
            out.append((start, end))
    return out


def entity(kind: int, value: str) -> int:
    """A 64-bit number for a base entity, however it was written."""
    plain = _DIGITS.sub("", value) if kind in (2, 3) else value.translate(_LOWER)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def windows_of(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(entity, window's hash, terms) around each base entity; a term counts once for an entity, in the first window it is in."""
    spans = found(text)
    if not spans:
        return
    places = terms(text, merged(spans))
    starts = [s for s, _ in places]
    done: dict[int, int] = {}
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        e = entity(kind, text[start:end])
        at = bisect_left(starts, start)
        first, last = max(at - WINDOW, 0), min(at + WINDOW, len(places))
        words = [text[s:t].translate(_LOWER) for s, t in places[first:last]]
        w = hashlib.blake2b("\n".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        new = max(first, done.get(e, 0))
        done[e] = max(last, done.get(e, 0))
        yield e, int.from_bytes(w, "big", signed=True), words[new - first :]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "e", "w", "ts"]
    types = [pa.int64()] * 4 + [pa.list_(pa.string())]
    for batch in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for row in windows_of(text or ""):
                for column, value in zip(out, (k1, k2, *row), strict=True):
                    column.append(value)
            if len(out[0]) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out = [[], [], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lower, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def stem(term: Column) -> Column:
    """A term's beginning, shorter by TAIL characters at least."""
    return F.concat(F.substring(term, F.lit(1), F.greatest(F.lit(1), F.least(F.lit(STEM), F.char_length(term) - TAIL))), F.lit("*"))


def sort_of(term: Column) -> Column:
    """What kind of term it is."""
    digits = F.regexp_like(term, F.lit("^[0-9]+$"))
    return F.when(digits, "[number]").when(F.regexp_like(term, F.lit("[0-9]")), "[code]").otherwise("[word]")


def disclosing() -> Column:
    """Whether n_ct of n_t occurrences tell too much of an entity with n_c of all terms."""
    posterior = F.col("n_ct") / F.col("n_t")
    information = -F.log2(F.col("n_c") / F.col("n_all"))
    # PMI over IC; an entity around every term has no information to give away.
    told = F.when(information > 0, 1 + F.log2(posterior) / information).otherwise(0.0)
    return (posterior >= POSTERIOR) & (told >= DISCLOSURE)


def disclosures(near: DataFrame, docs: DataFrame, text: Column) -> DataFrame | None:
    """(e, term, instead): the terms that give entity e away and what stands in their place, empty where nothing does; None if there is none; written."""
    pairs = near.select("e", "w", F.explode("ts").alias("term")).groupBy("e", "w", "term").agg(F.count("*").alias("n"))
    pairs = written(pairs.groupBy("e", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("windows")), "pairs")
    able = written(pairs.where(F.col("windows") >= SUPPORT).select("e", "term", "n_ct"), "able")
    if able.isEmpty():
        return None
    around = near.groupBy("e").agg(F.sum(F.size("ts")).alias("n_c")).join(able.select("e").distinct(), "e", "left_semi")
    vocabulary = docs.select(F.explode(words_of(text)).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_t"))
    vocabulary = written(vocabulary, "vocabulary")
    n_all = vocabulary.agg(F.sum("n_t")).first()[0] or 1
    around = written(around.withColumn("n_all", F.lit(n_all)), "around")
    n_around = around.count()
    told = able.join(vocabulary, "term").join(small(around, n_around), "e").where(disclosing()).select("e", "term")
    told = written(told, "told")
    n_told = told.count()
    if not n_told:
        return None
    # General forms of what is told only; how often these stand in the corpus and by the entity.
    forms = told.select("e", "term", F.posexplode(F.array(stem(F.col("term")), sort_of(F.col("term")))).alias("level", "form"))
    forms = written(forms, "forms")
    asked = forms.select("form").distinct()
    shapes = lambda c: F.explode(F.array(stem(c), sort_of(c))).alias("form")
    n_asked = asked.count()
    all_of = vocabulary.select("n_t", shapes(F.col("term"))).join(small(asked, n_asked), "form").groupBy("form").agg(F.sum("n_t").alias("n_t"))
    wanted = forms.select("e", "form").distinct()
    mine = pairs.join(small(told.select("e").distinct(), n_told), "e", "left_semi").select("e", "n_ct", shapes(F.col("term")))
    mine = mine.join(small(wanted, n_told * 2), ["e", "form"]).groupBy("e", "form").agg(F.sum("n_ct").alias("n_ct"))
    safe = mine.join(small(all_of, n_asked), "form").join(small(around, n_around), "e").where(~disclosing()).select("e", "form")
    best = forms.join(safe, ["e", "form"]).groupBy("e", "term").agg(F.min_by("form", "level").alias("instead"))
    return written(told.join(best, ["e", "term"], "left").select("e", "term", F.coalesce("instead", F.lit("")).alias("instead")), "disclosures")


def by_text(near: DataFrame, docs: DataFrame, text: Column, keys: list[Column], told: DataFrame) -> DataFrame:
    """(k1, k2, hide): for each text with entities, term and replacement of the terms in it that give one of them away; written."""
    n = told.count()
    held = near.select("k1", "k2", "e").distinct().join(small(told.select("e").distinct(), n), "e", "left_semi")
    held = written(held, "held")
    at = held.select("k1", "k2").distinct()
    words = docs.select(*keys, text.alias("t_")).join(small(at, held.count()), ["k1", "k2"], "left_semi")
    # A text's copies say the same: their words are made distinct in every task, then together.
    words = words.select("k1", "k2", F.explode(F.array_distinct(words_of(F.col("t_")))).alias("term")).join(small(told.select("term").distinct(), n), "term", "left_semi").distinct()
    hits = words.join(small(told, n), "term").join(held, ["k1", "k2", "e"], "left_semi")
    # Of what different entities ask for, the more general form counts: removal, kind, beginning.
    hits = hits.groupBy("k1", "k2", "term").agg(F.min_by("instead", F.struct(F.length("instead") > 0, ~F.startswith("instead", F.lit("[")), "instead")).alias("instead"))
    return written(hits.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("hide")), "hide")


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("instead", T.StringType())]))
_RESULT = T.StructType([T.StructField("sanitised", T.StringType()), T.StructField("spans", _SPAN)])


def sanitised(text: str, hide: dict[str, str]) -> tuple[str, list[dict]]:
    """The text with entities and disclosing terms replaced, and the spans: base entities by kind and start, then terms."""
    base = found(text)
    spans = [{"kind": KINDS[k], "start": s, "end": e, "instead": f"[{KINDS[k].upper()}]"} for k, s, e in base]
    covered = merged(base)
    cuts = [(s, e, f"[{KINDS[k].upper()}]") for s, e, k in covered]
    if hide and base:
        for s, e in terms(text, covered):
            if (instead := hide.get(text[s:e].translate(_LOWER))) is not None:
                spans.append({"kind": "term", "start": s, "end": e, "instead": instead})
                cuts.append((s, e, instead))
        cuts.sort()
    parts, at = [], 0
    for s, e, instead in cuts:
        parts += [text[at:s], instead]
        at = e
    return "".join([*parts, text[at:]]), spans


@F.arrow_udf(_RESULT)
def _sanitised(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, hides in columns:
        done = []
        for start in range(0, len(texts), 64):
            for text, hide in zip(texts.slice(start, 64).to_pylist(), hides.slice(start, 64).to_pylist(), strict=True):
                new, spans = sanitised(text or "", dict(hide or ()))
                done.append({"sanitised": new, "spans": spans})
        yield pa.array(done, pa.struct([("sanitised", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instead", pa.string())])))]))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sanitised, the text without personal data and what gives it away, and spans (kind, start, end, instead) of the text as it was."""
    names = [c for c in docs.columns if c not in ("sanitised", "spans") or c == text_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    # Columns go by their places, so that none is called like a helper.
    at = [f"c{i}_" for i in range(len(names))]
    rows = docs.toDF(*at)
    text = F.coalesce(F.col(at[names.index(text_col)]), F.lit(""))
    keys = [F.xxhash64(F.lit(s), text).alias(k) for k, s in (("k1", 41), ("k2", 42))]
    none = F.lit(None).cast("map<string,string>")
    with scope() as kept:
        near = written(rows.select(*keys, text.alias("t")).mapInArrow(_windows, "k1 long, k2 long, e long, w long, ts array<string>"), "windows")
        told = disclosures(near, rows, text)
        hide = by_text(near, rows, text, keys, told) if told is not None else None
        n_hide = hide.count() if hide is not None else 0
        if n_hide:
            kept.append(hide)
    if n_hide:
        full = rows.select(*at, *keys).join(small(hide, n_hide, 100_000), ["k1", "k2"], "left")
    else:
        full = rows.withColumn("hide", none)
    full = full.select(*at, _sanitised(text, F.col("hide")).alias("r_"))
    kept_names = [c for c in names if c not in ("sanitised", "spans")]
    return full.select(*[F.col(at[names.index(c)]).alias(c) for c in kept_names], F.col("r_.sanitised").alias("sanitised"), F.col("r_.spans").alias("spans"))


def digest(spans: Column, base: bool = False) -> Column:
    """kind:start:end of all spans, or of base ones only, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"] != "term") if base else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sanitise(docs).select("doc_id", "spans")
    n = [number(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(digest(F.col("spans"), True), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))

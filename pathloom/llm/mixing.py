"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells are raked: in turn, the
cells of every source, language and topic are scaled so that their sum meets its target share, ROUNDS
times over. A cell's fitted over its natural share is its boost. Every document of a cell is then kept with
probability boost over largest boost, decided by a hash of its id, so the kept tokens have the raked
mixture in expectation and nothing is repeated: the rarer a cell is next to its target, the fewer of the
others are kept.

Targets are parameters, so the number of cells is bounded by their sizes, not by the data: categories
without a target (null among them) share one cell name and keep their natural share; targets of absent
categories are dealt to those present. Tokens are runs of non-white-space, of a null text none. Repeated
rows are kept or dropped together; with an empty table, or one without tokens, nothing is dropped.
Columns of other names pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.56, "de": 0.16, "fr": 0.16, "es": 0.12}
TOPICS = {"prose": 0.9, "tabular": 0.03, "contact": 0.03, "legal": 0.04}
ROUNDS = 20
SEED = 31
REST = "(rest)"


def topic_of(text: Column) -> Column:
    """Topic by the first marker that a text holds."""
    low = F.lower(text)
    legal = F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright"))
    return F.when(F.contains(text, F.lit(" | ")), "tabular").when(F.contains(text, F.lit("@")), "contact").when(legal, "legal").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Runs of characters other than space and \\x09 to \\x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A number from 0 to below 1 for each id."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")).cast("binary")), F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))


def shares(natural: Mapping[str, float], targets: Mapping[str, float]) -> dict[str, float]:
    """Target share of each category that has tokens, summing to one."""
    rest = natural.get(REST, 0.0)
    there = {c: t for c, t in targets.items() if natural.get(c, 0.0) > 0 and t > 0}
    total = sum(there.values())
    out = {c: (1 - rest) * t / total for c, t in there.items()}
    return out | ({REST: rest} if rest > 0 else {})


def boosts(cells: Mapping[tuple[str, ...], int], targets: list[Mapping[str, float]]) -> dict[tuple[str, ...], float]:
    """Raked over natural share of every cell with tokens."""
    total = sum(cells.values())
    if not total:
        return {}
    natural = {c: n / total for c, n in sorted(cells.items()) if n > 0}
    fitted = dict(natural)
    aims = []
    for d, target in enumerate(targets):
        margin: dict[str, float] = {}
        for c, w in natural.items():
            margin[c[d]] = margin.get(c[d], 0.0) + w
        aims.append(shares(margin, target))
    for _ in range(ROUNDS):
        for d, aim in enumerate(aims):
            margin = {}
            for c, w in fitted.items():
                margin[c[d]] = margin.get(c[d], 0.0) + w
            fitted = {c: w * aim.get(c[d], 0.0) / margin[c[d]] if margin[c[d]] > 0 else 0.0 for c, w in fitted.items()}
    return {c: w / natural[c] for c, w in fitted.items()}


def mixed(docs: DataFrame, dims: Mapping[str, tuple[Column, Mapping[str, float]]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the cell's categories under the names of dims, probability and kept; columns of these names are replaced."""
    names = list(dims)
    # Categories are worked out before anything is dropped, for they may come from columns of the same names.
    cats = [F.when(F.coalesce(c.isin(*t), F.lit(False)), c).otherwise(REST) for c, t in dims.values()]
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(f"__pl_cat{i}") for i, c in enumerate(cats)])
    at = [f"__pl_cat{i}" for i in range(len(names))]
    cells = {tuple(r[: len(at)]): r[-1] for r in keyed.groupBy(*at).agg(F.sum(tokens_of(F.col(text_col))).alias("n")).collect()}
    boost = boosts(cells, [t for _, t in dims.values()])
    top = max(boost.values(), default=1.0) or 1.0
    rates = docs.sparkSession.createDataFrame([(*c, b / top) for c, b in boost.items()], ", ".join(f"{c} string" for c in at) + ", probability double")
    # As many rows as cells, which the targets bound.
    out = keyed.drop(*names, "probability", "kept").join(F.broadcast(rates), at, "left")
    out = out.withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("kept", draw(F.col(id_col)) < F.col("probability"))
    return out.withColumnsRenamed(dict(zip(at, names, strict=True)))


def report(out: DataFrame, dims: Mapping[str, tuple[Column, Mapping[str, float]]], text_col: str = "text") -> DataFrame:
    """Of what mixed() gives, a row per dimension and category: tokens' natural share, target, share expected of the draw, and realised."""
    n, p = tokens_of(F.col(text_col)), F.col("probability")
    kinds = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dims])).alias("k")
    sums = out.select(kinds, n.alias("n"), (n * p).alias("e"), F.when(F.col("kept"), n).otherwise(0).alias("r")).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "e", "r")])
    every = Window.partitionBy("k.dimension")  # a few categories each
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0))
    aims = out.sparkSession.createDataFrame([(d, c, float(t)) for d, (_, target) in dims.items() for c, t in target.items()], "dimension string, category string, target double")
    told = sums.select("k.dimension", "k.category", share("n").alias("natural"), share("e").alias("expected"), share("r").alias("realised"))
    return told.join(F.broadcast(aims), ["dimension", "category"], "left")


def dims_of() -> dict[str, tuple[Column, Mapping[str, float]]]:
    return {"source": (F.col("source"), SOURCES), "lang": (F.col("lang"), LANGUAGES), "topic": (topic_of(F.coalesce("text", F.lit(""))), TOPICS)}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mixed(docs, dims_of()).select("doc_id", "source", "lang", "topic", tokens_of(F.col("text")).alias("n_tokens"), F.round("probability", 6).alias("probability"), "kept")


def sample(docs: DataFrame) -> DataFrame:
    """The documents drawn, with the columns of docs."""
    copies = docs.select("doc_id", "text", "source", "lang", *[F.col(f"`{c}`").alias(f"__pl_keep_{c}") for c in docs.columns])
    keep = mixed(copies, dims_of())
    # What the draw adds is dropped, and columns of docs that its names replaced are not lost: they come from copies.
    return keep.where("kept").select(*[F.col(f"`__pl_keep_{c}`").alias(c) for c in docs.columns])


def _oracle() -> str:
    in_list = lambda t: ", ".join(f"'{c}'" for c in t)
    aim = lambda d, t: f"t{d} as materialized (select c, case when c = '{REST}' then w else (1 - coalesce((select w from m{d} where c = '{REST}'), 0)) * t / (select sum(t) from g{d} join m{d} using (c)) end as aim from m{d} left join g{d} using (c))"
    parts = [
        f"""d as materialized (select doc_id, case when source in ({in_list(SOURCES)}) then source else '{REST}' end as c0, case when lang in ({in_list(LANGUAGES)}) then lang else '{REST}' end as c1,
  case when contains(coalesce(text, ''), ' | ') then 'tabular' when contains(coalesce(text, ''), '@') then 'contact' when regexp_matches(coalesce(text, ''), '(?i)license|copyright') then 'legal' else 'prose' end as c2,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n from documents)""",
        "cells as materialized (select c0, c1, c2, sum(n) as n from d group by all having sum(n) > 0)",
        "w0 as materialized (select c0, c1, c2, n / (select sum(n) from cells) as nat, n / (select sum(n) from cells) as w from cells)",
    ]
    for d, t in enumerate((SOURCES, LANGUAGES, TOPICS)):
        parts.append(f"g{d}(c, t) as (values " + ", ".join(f"('{c}', {v}::double)" for c, v in t.items()) + ")")
        parts.append(f"m{d} as materialized (select c{d} as c, sum(w) as w from w0 group by 1)")
        parts.append(aim(d, t))
    k = 0
    for _ in range(ROUNDS):
        for d in range(3):
            parts.append(f"w{k + 1} as materialized (select x.c0, x.c1, x.c2, x.nat, x.w * t.aim / s.s as w from w{k} x join t{d} t on t.c = x.c{d} join (select c{d} as c, sum(w) as s from w{k} group by 1) s on s.c = x.c{d})")
            k += 1
    parts.append(f"b as materialized (select c0, c1, c2, w / nat as b from w{k})")
    parts.append("r as materialized (select c0, c1, c2, b / (select max(b) from b) as p from b)")
    u = f"cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) / {1 << 48}.0::double"
    return f"with {', '.join(parts)} select doc_id, d.c0 as source, d.c1 as lang, d.c2 as topic, cast(n as bigint) as n_tokens, round(coalesce(p, 1.0), 6) as probability, {u} < coalesce(p, 1.0) as kept from d left join r using (c0, c1, c2)"


ORACLE = _oracle()

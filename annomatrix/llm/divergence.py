"""How far the sources of a language lie apart in their words: an L1 distance of every pair of sources, and the words
that set a source off from its language.

Terms are counted once per source. A term that many sources of its language use is heavy, any other light. With p of a
source that does not use a term written p0, all pairs of sources start from V * |p0 - p0'|, as if no term were used.
Heavy terms correct that in dense tiles: blocks of terms by two blocks of sources as numpy matrices. Light terms correct
it in two parts: a source's own light counts against the p0 of all others, again by tiles, as equal counts have equal p;
and for each light term, of at most LIGHT_MAX sources, the pairs of its postings. All numbers are 64-bit integers, and so
the partial sums of both kinds add up exactly.

Null text, lang and source are ''. A repeated row counts again. A language of one source has no pairs. Without kept terms
every distance is 0 and there are no term rows. An empty table gives an empty one. Other columns of documents are not read. The
distances of one language's sources are many as its sources squared, which is what is asked for; numbering the sources of
one language is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch
from .skew import join_counted
from .terms import LETTERS, per_text, runs, terms_of

#: Documents of a language that a kept term is in.
LEAST_DOCS = 30
#: Terms reported of each source.
TOP_TERMS = 50
PRIOR = 5
#: A term is heavy in more than one of SHARE sources of its language, or in more than LIGHT_MAX.
SHARE, LIGHT_MAX = 4, 256
#: Sources on a side of a tile, and terms in it, some.
BLOCK, TILE_TERMS = 256, 4096
COUNTED = "lang string, source string, term string, n long, docs long"
CELLS = "array<struct<pos int, v long>>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in the texts of a source, and how many of those texts hold it, by runs of texts."""
    for table in runs(batches):
        terms, bounds = terms_of(table.column("text"), LETTERS)
        text, code, times = per_text(terms, bounds)
        lang, source = (table.column(c).combine_chunks() for c in ("lang", "source"))
        pair = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lang, source)]
        _, one, group = np.unique(pair[0] * len(table) + pair[1], return_index=True, return_inverse=True)
        width = max(1, len(terms.dictionary))
        key, at = np.unique(group[text] * width + code, return_inverse=True)
        n, docs = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        row = pa.array(one[key // width])
        term = terms.dictionary.take(pa.array(key % width)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang.take(row), source.take(row), term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (count + PRIOR) / total), three digits at a time, so that no product leaves 64 bits."""
    rest, out = f"({count} + {PRIOR}L)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000L + ({rest} * 1000L) div {total})", f"(({rest} * 1000L) % {total})"
    return f"if({total} > 0, 1L + {out}, 0L)"


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """What one block of terms adds to the distance of each source of block a to each of block b."""
    lang, part, a, b = (k.as_py() for k in key)
    blk, kind = (rows.column(c).to_numpy() for c in ("blk", "kind"))
    lists = rows.column("cells").combine_chunks()
    many = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(rows)), many)
    pos, v = (lists.flatten().field(c).to_numpy() for c in ("pos", "v"))
    p = rows.column("p").to_numpy(zero_copy_only=False)

    def base(block: int) -> np.ndarray:
        i = int(np.flatnonzero((kind == 0) & (blk == block))[0])
        out = np.zeros(many[i], dtype=np.int64)
        out[pos[row == i]] = v[row == i]
        return out

    base_a, base_b = base(a), base(b)
    apart = np.abs(base_a[:, None] - base_b)
    out = apart * int(rows.column("kept")[0].as_py()) if part == 0 else np.zeros_like(apart)

    heavy = kind == 1
    if heavy.any():
        terms = rows.column("term").combine_chunks().dictionary_encode()
        code = np.zeros(len(rows), dtype=np.int64)
        code[heavy] = terms.indices.drop_null().to_numpy()

        def dense(block: int, start: np.ndarray) -> np.ndarray:
            x = np.repeat(start[:, None], len(terms.dictionary), 1)
            at = (heavy & (blk == block))[row]
            x[pos[at], code[row[at]]] = v[at]
            return x

        x, y = dense(a, base_a), dense(b, base_b)
        for i in range(len(x)):
            out[i] += np.abs(y - x[i]).sum(1)
        out -= apart * len(terms.dictionary)

    def light(block: int, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Terms that a source of block alone uses: v terms of the given p, against the p0 of others."""
        x = np.zeros((len(own), len(other)), dtype=np.int64)
        at = np.flatnonzero(((kind == 2) & (blk == block))[row])
        at = at[np.argsort(pos[at], kind="stable")]
        for run in np.split(at, np.flatnonzero(np.diff(pos[at])) + 1) if len(at) else []:
            i = pos[run[0]]
            x[i] = (v[run, None] * (np.abs(p[row[run], None] - other) - np.abs(own[i] - other))).sum(0)
        return x

    out += light(a, base_a, base_b) + light(b, base_b, base_a).T
    i, j = np.nonzero(np.triu(np.ones(out.shape), 1)) if a == b else np.nonzero(np.ones(out.shape))
    size = int(rows.column("block")[0].as_py())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": a * size + i, "b": b * size + j, "value": out[i, j]})


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, share: int = SHARE, light_max: int = LIGHT_MAX, block: int = BLOCK, tile_terms: int = TILE_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): in part 'pair' the distance of a source to each other of its language,
    in part 'term' the words it uses most above its language."""
    spark = docs.sparkSession
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")}
    docs = docs.select(*text.values())
    with scratch(spark) as kept_tables:
        counted = docs.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counted = materialize(counted, "divergence-counts")
        kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("users"))
        uses = materialize(counted.drop("docs").join(kept.where(F.col("docs") >= least_docs).drop("docs"), ["lang", "term"]), "divergence-uses")

        of_lang = uses.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
        of_source = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n"))
        groups = docs.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").na.fill(0)
        by_lang = Window.partitionBy("lang")
        groups = groups.withColumns(
            {
                "gid": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long"),
                "sources": F.count(F.lit(1)).over(by_lang),
                "total": F.expr(f"total + {PRIOR}L * kept"),
                "lang_total": F.expr(f"lang_total + {PRIOR}L * kept"),
            }
        )
        groups = groups.withColumns({"p0": F.expr(_share("0L", "total")), "blk": F.expr(f"gid div {block}"), "pos": F.expr(f"int(gid % {block})")})
        groups = materialize(groups, "divergence-groups")

        uses = join_counted(uses.withColumnRenamed("n", "used"), groups, ["lang", "source"], "divergence-sources")
        heavy = F.expr(f"users * {share} > sources or users > {light_max}")
        p, q = F.expr(_share("used", "total")), F.expr(_share("lang_n", "lang_total"))
        uses = uses.select("lang", "source", "term", "gid", "blk", "pos", "p0", p.alias("p"), q.alias("q"), heavy.alias("heavy"))
        uses = materialize(uses, "divergence-shares")

        named = groups.select("lang", "gid", "source")
        ends = [named.select("lang", F.col("gid").alias(c), F.col("source").alias(f"{c}_name")) for c in ("a", "b")]
        pairs = _pairs(uses, groups, block, tile_terms).join(ends[0], ["lang", "a"]).join(ends[1], ["lang", "b"])
        both = F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item"))))
        pairs = pairs.select("lang", both.alias("ends"), "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
        terms = uses.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        out = pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))
        out = materialize(out, "divergence")
        kept_tables.append(out)
    return out


def _pairs(uses: DataFrame, groups: DataFrame, block: int, tile_terms: int) -> DataFrame:
    """(lang, a, b, value) of sources a < b by number."""
    cell = lambda v: F.collect_list(F.struct("pos", F.col(v).cast("long").alias("v"))).alias("cells")
    some, none = F.lit(None).cast("string"), F.lit(0).cast("long")
    heavy = uses.where("heavy").groupBy("lang", "term", "blk").agg(cell("p"))
    heavy = heavy.select("lang", "blk", F.lit(1).alias("kind"), "term", none.alias("p"), "cells")
    light = uses.where("not heavy")
    alone = light.groupBy("lang", "blk", "pos", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "blk", "p").agg(cell("m"))
    alone = alone.select("lang", "blk", F.lit(2).alias("kind"), some.alias("term"), "p", "cells")
    rows = materialize(heavy.unionByName(alone), "divergence-cells")

    of_lang = groups.groupBy("lang").agg(F.max("kept").alias("kept"), (F.max("blk") + 1).alias("blocks"))
    of_lang = of_lang.join(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left").na.fill(0)
    of_lang = materialize(of_lang.withColumn("parts", F.expr(f"1 + n div {tile_terms}")), "divergence-langs")
    rows = join_counted(rows, of_lang, ["lang"], "divergence-heavy-langs").withColumn("part", F.expr("pmod(xxhash64(term, p), parts)"))
    start = groups.groupBy("lang", "blk").agg(cell("p0")).join(of_lang, "lang")
    start = start.select("*", F.lit(0).alias("kind"), some.alias("term"), none.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    names = ["lang", "part", "blk", "kind", "term", "p", "cells", "kept", "blocks"]
    rows = rows.select(*names).unionByName(start.select(*names))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(*names[:-1], F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), F.lit(block).alias("block"))
    tiles = rows.groupBy("lang", "part", "a", "b").applyInArrow(_tile, "lang string, a long, b long, value long")

    side = lambda g: light.select("lang", "term", F.col("gid").alias(g), F.col("p").alias(f"p_{g}"), F.col("p0").alias(f"p0_{g}"))
    shared = side("a").join(side("b"), ["lang", "term"]).where("a < b")
    more = "abs(p_a - p_b) - abs(p_a - p0_b) - abs(p0_a - p_b) + abs(p0_a - p0_b)"
    shared = shared.select("lang", "a", "b", F.expr(more).alias("value"))
    return tiles.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""with d as (select row_number() over () as id, coalesce(lang, '') lang, coalesce(source, '') source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by 1, 2 having count(distinct id) >= {LEAST_DOCS}),
v as (select lang, count(*) as v from k group by 1),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by 1, 2, 3),
g as (select *, coalesce((select sum(n) from c where c.lang = d.lang and c.source = d.source), 0) + {PRIOR} * coalesce((select v from v where v.lang = d.lang), 0) as total from (select distinct lang, source from d) d),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + {PRIOR})) // total::hugeint)::bigint as p
    from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
lt as (select lang, sum(n) + {PRIOR} * any_value(v) as total from c join v using (lang) group by 1),
q as (select lang, term, (1 + (1000000000::hugeint * (sum(n) + {PRIOR})) // any_value(total)::hugeint)::bigint as q from c join lt using (lang) group by 1, 2),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank::integer as rank from r where part = 'pair' or rank <= {TOP_TERMS}"""

"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is lower-cased (A-Z) and cut where its own content says so: after at least
``CHUNK_MIN`` characters, behind the first letter-and-space pair of a fixed class, and
at ``CHUNK_MAX`` at the latest. An insertion moves the cuts near it only, so copies and
versions share chunks. Distinct chunks are gathered once, which verifies that an
identifier stands for one chunk text; a document is then its ordered identifier list
(16 bytes for some half thousand characters), and lists alone are compared and moved.

If an identifier function ever gives two chunk texts one name, the next, longer one is
used; the last is the chunk text itself, so the result is exact in any case.

Results: a null text counts as empty, and empty texts are one group. Of equal texts the
row with the largest id stays; null ids count as smaller than any (a group without any
id has a null keep_id and all its rows are marked kept). Repeated rows (equal id and
text) are one document: they share keep_id and are all marked kept. Extra columns are
never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, ascii_lower, materialize, row_key, small

CHUNK_MIN, CHUNK_MAX = 512, 4096
#: Identifiers by rising length: 128 bits, 256 bits, the chunk itself.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda c: F.unhex(F.md5(c)),
    lambda c: F.unhex(F.sha2(c, 256)),
    lambda c: c.cast("binary"),
)


def chunks(text: Column) -> Column:
    """Ordered chunks; they join up to the text again. The empty text has none."""
    cut = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX - 2}}}?[bdfhkmnpst][ \n]|.{{1,{CHUNK_MAX}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def clashes(chunked: DataFrame, identify: Callable[[Column], Column], keep: Scratch) -> int:
    """How many identifiers stand for several chunk texts (0: verified).

    Only an identifier that occurs more than once can, so identifiers are counted first and
    the texts of repeated ones alone are compared.
    """
    named = chunked.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("ident"), "chunk")
    repeated = keep(named.groupBy("ident").agg(F.count("*").alias("n")).filter("n > 1").select("ident"), "repeated")
    texts = named.join(small(repeated), "ident", "left_semi").distinct()
    return texts.groupBy("ident").count().filter("count > 1").limit(1).count()


def recipes(docs: DataFrame, keep: Scratch, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """(doc_id, row_key, recipe, text_sha256) with verified identifiers, written."""
    normal = docs.select("doc_id", "row_key", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    chunked = normal.select("doc_id", "row_key", "text", chunks(F.col("text")).alias("chunks"))
    for identify in identifiers[:-1]:
        if clashes(chunked, identify, keep) == 0:
            break
    else:
        identify = identifiers[-1]
    return keep(chunked.select("doc_id", "row_key", F.transform("chunks", identify).alias("recipe"), F.sha2(F.col("text"), 256).alias("text_sha256")), "recipes")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS, with_rows: bool = False
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``df``.

    ``with_rows`` adds ``row_key`` (128 bits of the text as it stands) and ``grouped`` (the
    name of the group), by which a row without an own id is known.
    """
    with Scratch(df.sparkSession) as keep:
        text = df[text_col]
        own = recipes(df.select(df[id_col].alias("doc_id"), row_key(text).alias("row_key"), text.alias("text")), keep, identifiers)
        groups = keep(own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
        both = own.join(groups, "recipe")
        more = ["row_key", F.col("text_sha256").alias("grouped")] if with_rows else []
        out = both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *more)
        return materialize(out, "exact")

"""Several values packed in one field: the delimiters of each source are inferred, then fields are split with position.

Inference scores every candidate character on the fields of a source, with quoted stretches masked:

* regularity: the share of its occurrences between two pieces of the source's usual kind (codes, numbers or phrases,
  whichever is most frequent), quoted pieces, other delimiters or an end of the field;
* consistency: of the fields in which it is the only candidate, the share in which splitting by it leaves as many
  pieces of the usual kind as there are pieces.

A candidate whose mean score reaches `min_score` delimits in that source; a source may have several. Statistics are
sums per source (combined before the shuffle), so one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import BLANKS, strip_blanks
from ledgerloom.operators.bounded import broadcast_if_bounded, lookup_join
from ledgerloom.session import written

#: Characters tried as delimiters. The first group is usual in lists and starts with one occurrence in its
#: favour, the second starts with one against it.
USUAL = (",", ";", "|", "\t", "\n", "\r")
UNUSUAL = ("/", "\u00a6", "&", "-", ":", "+", "#", "~", "^", "*", "\u00b7", "\u2022", "\uff0c", "\u3001", "\uff1b")
#: Brackets that may enclose a whole list.
BRACKETS = (("[", "]"), ("{", "}"), ("(", ")"), ("<", ">"))

_DOUBLE = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_SINGLE = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_QUOTED = f"(?:{_DOUBLE}|{_SINGLE})"
_MASK = "\ue000"


def _class(chars: str | tuple[str, ...]) -> str:
    return "".join({"\t": r"\t", "\n": r"\n", "\r": r"\r"}.get(c, "\\" + c if not c.isalnum() and ord(c) < 128 else c) for c in chars)


_ALL = _class(USUAL + UNUSUAL)


def unbracketed(c: Column) -> Column:
    """The list without surrounding blanks and without brackets around the whole of it."""
    s = strip_blanks(c)
    out = s
    for a, b in BRACKETS:
        inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
        # Square and curly brackets enclose lists; round and pointed ones only if no other pair of them is inside.
        whole = s.startswith(a) & s.endswith(b) & (F.length(s) >= 2)
        if a in "(<":
            whole = whole & ~inner.rlike(f"[{_class((a, b))}]")
        out = F.when(whole, inner).otherwise(out)
    return out


def _kinds(c: Column) -> Column:
    """The field with every piece between candidates replaced by its kind: q quoted, c code, n number, p phrase."""
    s = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}\"'\\])(?:{_DOUBLE}|{_SINGLE})(?=[ \u00a0]*+(?:$|[^\p{{L}}\p{{N}} \u00a0\"']))", _MASK)
    edge, end = f"(?<=^|[{_ALL}])[ \u00a0]*+", f"[ \u00a0]*+(?=$|[{_ALL}])"
    s = F.regexp_replace(s, f"{edge}{_MASK}{end}", "\ue001")
    s = F.regexp_replace(s, f"{edge}[0-9]+(?:[.][0-9]+)?{end}", "\ue003")
    s = F.regexp_replace(s, f"{edge}[\\p{{L}}0-9_.]++{end}", "\ue002")
    s = F.regexp_replace(s, f"[^{_ALL}\ue001-\ue003]*[^{_ALL}\ue001-\ue003\\s][^{_ALL}\ue001-\ue003]*", "\ue004")
    return F.translate(F.regexp_replace(s, "[ \u00a0]+", ""), "\ue001\ue002\ue003\ue004", "qcnp")




def infer_delimiters(df: DataFrame, value: str, source: Column | None = None, min_score: float = 0.6) -> DataFrame:
    """(source string, delimiters string): the delimiting characters of each source, '' if there are none.

    Null and blank fields say nothing. A source without a field that has a candidate gets ''. The empty table gives no row.
    """
    src = F.coalesce(source.cast("string"), F.lit("")) if source is not None else F.lit("")
    fields = df.select(src.alias("source"), _kinds(unbracketed(F.col(value))).alias("k")).where("k is not null and k <> ''").groupBy("source", "k").count()
    fields = written(fields, "packed")  # few patterns of kinds, read several times below
    main = fields.groupBy("source").agg(*[F.sum(F.regexp_count("k", F.lit(x)) * F.col("count")).alias(x) for x in "cnp"])
    usual = F.when((F.col("c") >= F.col("n")) & (F.col("c") >= F.col("p")), "c").when(F.col("n") >= F.col("p"), "n").otherwise("p")
    fields = fields.join(broadcast_if_bounded(main.select("source", usual.alias("usual"))), "source")
    # Kinds other than the usual one become x, so that the patterns below are constants.
    k = F.when(F.col("usual") == "c", F.translate("k", "np", "xx")).when(F.col("usual") == "n", F.translate("k", "cp", "xx")).otherwise(F.translate("k", "cn", "xx"))
    fields = fields.select("source", "count", k.alias("k"))
    aggregates, scores = [], []
    for i, d in enumerate(USUAL + UNUSUAL):
        e = _class((d,))
        n, good = F.regexp_count("k", F.lit(f"[{e}]")), F.regexp_count("k", F.lit(f"(?<=[cnpq{_ALL}]|^)[{e}](?=[cnpq{_ALL}]|$)"))
        alone = F.col("k").rlike(f"[{e}]") & ~F.col("k").rlike(f"[{_ALL}&&[^{e}]]")
        aggregates += [F.sum(n * F.col("count")).alias(f"n{i}"), F.sum(good * F.col("count")).alias(f"g{i}"), F.sum(F.when(alone, F.col("count")).otherwise(0)).alias(f"a{i}"), F.sum(F.when(alone & ~F.col("k").contains("x"), F.col("count")).otherwise(0)).alias(f"o{i}")]
        prior = 1 if d in USUAL else 0
        regular = (F.col(f"g{i}") + prior) / (F.col(f"n{i}") + 1)
        consistent = (F.col(f"o{i}") + prior) / (F.col(f"a{i}") + 1)
        score = F.when(F.col(f"a{i}") > 0, (regular + consistent) / 2).otherwise(regular)
        scores.append(F.when((F.col(f"n{i}") > 0) & (score >= min_score), d).otherwise(""))
    return fields.groupBy("source").agg(*aggregates).select("source", F.concat(*scores).alias("delimiters"))


def split_packed(df: DataFrame, keys: list[str], value: str, out: str = "value", pos: str = "pos", source: Column | None = None, min_score: float = 0.6) -> DataFrame:
    """One row per value: keys, `pos` (from 1 over the non-empty values) and `out`.

    Delimiters inside quotes don't split; the quotes around a value go, a doubled or backslashed quote mark inside
    stands for one. A quote mark inside a word is an ordinary character. Null, blank and empty fields give no rows;
    repeated rows and repeated values keep rows of their own. Other columns, also ones named like the outputs, are left.
    """
    src = F.coalesce(source.cast("string"), F.lit("")) if source is not None else F.lit("")
    rows = df.select(*[F.col(x).alias(f"__key{i}") for i, x in enumerate(keys)], src.alias("__source"), unbracketed(F.col(value)).alias("__v")).where("__v <> ''")
    delimiters = infer_delimiters(df, value, source, min_score).withColumnRenamed("source", "__source")
    escaped = F.regexp_replace("delimiters", r"([^\p{L}\p{N}\s])", r"\\$1")
    stop = F.when(escaped == "", F.lit(_MASK)).otherwise(escaped)
    pattern = F.concat(F.lit(rf"{BLANKS}*+{_QUOTED}(?={BLANKS}*(?:$|["), stop, F.lit("]))|[^"), stop, F.lit("]+"))
    rows = lookup_join(rows, delimiters.select("__source", pattern.alias("__pattern")), ["__source"], "left")
    pieces = F.regexp_extract_all("__v", F.coalesce("__pattern", F.lit(r"(?s).+")), F.lit(0))
    values = F.filter(F.transform(pieces, lambda p: strip_blanks(_unquoted(strip_blanks(p)))), lambda p: p != "")
    return rows.select(*[F.col(f"__key{i}").alias(x) for i, x in enumerate(keys)], F.posexplode(values).alias("__p", out)).select(*keys, (F.col("__p") + 1).cast("int").alias(pos), out)


def _unquoted(p: Column) -> Column:
    inner = F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0)))
    return (
        F.when(p.rlike(rf"(?s)\A{_DOUBLE}\z"), F.regexp_replace(inner, r'\\"|""', '"'))
        .when(p.rlike(rf"(?s)\A{_SINGLE}\z"), F.regexp_replace(inner, r"\\'|''", "'"))
        .otherwise(p)
    )

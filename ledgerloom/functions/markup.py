"""Sections, tables and clauses of marked-up texts, and values written in them, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that stand for nothing.
NO_VALUE = ("", "-", "–", "—", "n/a")
#: Characters from which a clause is kept, those of its index entry, and rows of a table batch.
LEAST_CLAUSE, MOST_ENTRY, BATCH = 40, 1800, 15


def sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, seq, title, body): the sections under headings of two or three marks; what stands before the first has a null title.

    seq counts from 0 over all parts. Null texts give no rows, texts without headings one row with a null title.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    parts = F.split(t, r"(?m)(?=^#{2,3} )")
    d = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.filter(parts, lambda p: p != "")).alias("seq", "part"))
    titled = F.col("part").rlike(r"^#{2,3} ")
    title = F.when(titled, F.trim(F.regexp_extract("part", r"^#{2,3} ([^\n]*)", 1)))
    return d.select(*keys, "seq", title.alias("title"), F.when(titled, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")).alias("body"))


def section_with(df: DataFrame, keys: list[str], words: list[str]) -> DataFrame:
    """Of (keys, seq, title, body) the first section per key whose title has all words, in any case."""
    has = F.forall(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("title"), w))
    return df.where(has).groupBy(*keys).agg(F.min_by(F.struct("title", "body"), "seq").alias("m")).select(*keys, "m.title", "m.body")


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.when(F.trim(c).isin(*NO_VALUE), F.lit(None)).otherwise(F.trim(c)))


def table_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line, header, cells): the data rows of pipe tables, each with the header above it.

    A table is a run of neighbouring lines that begin with a pipe; its first line is the header, lines of dashes are
    left out, empty cells and dashes are null. Tables without data rows give none.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    d = df.where(F.col(text).contains("|")).select(*keys, F.transform(F.split(t, "\n"), lambda s: F.trim(s)).alias("__l"))
    # Runs of table rows by where they begin and end; every run is cut out once, so the work is in proportion to the text.
    row_at = lambda i: F.coalesce(F.startswith(F.get("__l", i), F.lit("|")), F.lit(False))
    places = F.sequence(F.lit(0), F.size("__l") - 1)
    first = F.filter(places, lambda i: row_at(i) & ~row_at(i - 1))
    last = F.filter(places, lambda i: row_at(i) & ~row_at(i + 1))
    d = d.select(*keys, "__l", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("__run"))
    run = F.slice("__l", F.col("__run.a") + 1, F.col("__run.b") - F.col("__run.a") + 1)
    d = d.select(*keys, F.col("__run.a").alias("__a"), F.element_at(run, 1).alias("__head"), F.posexplode(run).alias("__i", "__s"))
    d = d.where((F.col("__i") > 0) & ~F.col("__s").rlike(r"^[|\s:-]+$"))
    return d.select(*keys, (F.col("__a") + F.col("__i")).alias("line"), _cells(F.col("__head")).alias("header"), _cells(F.col("__s")).alias("cells"))


def cell_under(names: str) -> Column:
    """Of (header, cells) the cell under the first header that equals one of the |-separated names, in any case; else null."""
    out = F.lit(None).cast("string")
    for name in reversed(names.split("|")):
        at = F.array_position(F.transform(F.filter("header", lambda h: h.isNotNull()), lambda h: F.lower(h)), name.strip().lower())
        out = F.when(at > 0, F.get("cells", (at - 1).cast("int"))).otherwise(out)
    return out


def cents(c: Column) -> Column:
    """Whole cents of an amount such as 'GBP 1,301.25'; null if it has no digits or two points."""
    digits = F.regexp_replace(c, r"[^0-9.]", "")
    return F.when(digits != "", (digits.try_cast("decimal(18,2)") * 100).cast("long"))


def fraction(c: Column) -> Column:
    """The first percentage of a text as a fraction, signs left out; null if there is none."""
    p = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.when(p != "", (p.try_cast("decimal(12,4)") / 100).cast("decimal(9,6)"))


def first_integer(c: Column) -> Column:
    """The first whole number of a text; null if there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("long")


def clauses(df: DataFrame, keys: list[str], text: str, least: int = LEAST_CLAUSE, most: int = MOST_ENTRY) -> DataFrame:
    """(keys, seq, heading, clause, entry): paragraphs and numbered clauses under the last heading before them.

    A text is cut at blank lines, headings and lines that begin with a clause number; pieces under `least` characters
    are left out. The clause is whole; `entry` is its first `most` characters (the feature of an index entry).
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    parts = F.filter(F.split(t, r"\n\s*\n|(?m)(?=^#{1,6} )|(?m)(?=^\d+(?:\.\d+)+ )"), lambda p: F.trim(p) != "")
    d = df.where(F.col(text).isNotNull()).select(*keys, parts.alias("__p")).where(F.size("__p") > 0)
    # Blocks of parts from one heading to the next; every block is cut out once, so the work is in proportion to the text.
    begins = F.filter(F.sequence(F.lit(0), F.size("__p") - 1), lambda i: (i == 0) | F.get("__p", i).rlike("^#{1,6} "))
    ends = F.concat(F.slice(begins, 2, F.size("__p")), F.array(F.size("__p")))
    d = d.select(*keys, "__p", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("__b"))
    block = F.slice("__p", F.col("__b.a") + 1, F.col("__b.b") - F.col("__b.a"))
    d = d.select(*keys, F.col("__b.a").alias("__a"), F.element_at(block, 1).alias("__head"), F.posexplode(block).alias("__i", "__x"))
    heading = F.when(F.col("__head").rlike("^#{1,6} "), F.trim(F.regexp_extract("__head", r"^#{1,6} ([^\n]*)", 1)))
    body = F.trim(F.col("__x"))
    return d.select(*keys, (F.col("__a") + F.col("__i")).alias("seq"), heading.alias("heading"), body.alias("clause"), F.substring(body, 1, most).alias("entry")).where(F.length("clause") >= least)


def repaired_amounts(c: Column) -> Column:
    """The amounts after 'GBP ' in a text as cents, with letters that a scanner puts for digits read as digits (O 0, l I 1, S 5)."""
    spans = F.regexp_extract_all(c, F.lit(r"GBP ([0-9OolIS][0-9OolIS,]*(?:\.[0-9OolIS]+)?)"), F.lit(1))
    return F.filter(F.transform(spans, lambda s: cents(F.translate(s, "OolIS", "00115"))), lambda x: x.isNotNull())


def first_of(c: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern, in the order given, that a text has; null if none."""
    out = F.lit(None).cast("string")
    for name, p in reversed(list(patterns.items())):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def batches(df: DataFrame, keys: list[str], order: str, size: int = BATCH) -> DataFrame:
    """df with `batch` (from 0): the rows of a key in lots of `size` in their order."""
    from ledgerloom.operators.ordered import numbered

    d = numbered(df, keys, [F.col(order)], "__n")
    return d.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")


def normal(c: Column) -> Column:
    """Lower case with every run of other characters than letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def last_sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, seq, title, body) the titled sections, of those with the same title in one document the last."""
    return df.where("title is not null").groupBy(*keys, "title").agg(F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body")).select(*keys, "seq", "title", "body")


def articles(df: DataFrame, keys: list[str], text: str, marker: str, clause: str) -> DataFrame:
    """(keys, title, text, n_clauses): the sections whose title has the marker, with their clauses counted; for texts without
    one, the clauses gathered by the number before the first point of theirs.

    clause: a pattern that begins a clause on a line of its own. A text without such sections and clauses gives no rows.
    """
    s = last_sections(sections(df, keys, text), keys).where(F.contains(F.lower("title"), F.lit(marker.lower())))
    marked = s.select(*keys, "title", F.btrim("body", F.lit(" \t\n")).alias("text"), F.regexp_count("body", F.lit(f"(?m){clause}")).alias("n_clauses"))
    rest = df.where(F.col(text).isNotNull()).join(s.select(*keys).distinct(), keys, "left_anti")
    parts = F.filter(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), f"(?m)(?={clause})"), lambda p: F.rlike(p, F.lit(f"^{clause.lstrip('^')}")))
    c = rest.select(*keys, F.posexplode(parts).alias("__i", "__c")).withColumn("__n", F.split_part("__c", F.lit("."), F.lit(1)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.btrim("__c", F.lit(" \t\n")).alias("c")))), lambda x: x["c"]), "\n\n")
    return marked.unionByName(c.groupBy(*keys, "__n").agg(joined.alias("text"), F.count("*").cast("int").alias("n_clauses")).select(*keys, F.concat(F.lit("Article "), "__n").alias("title"), "text", "n_clauses"))


def table_batches(df: DataFrame, keys: list[str], size: int = BATCH, least: int = 3) -> DataFrame:
    """Of (keys, line, header, cells) lots of `size` rows as texts that keep their header: (keys, table, first, last, n_rows, text).

    `table` is the line of the table's header; tables of fewer than `least` rows are left out. Null cells are blank.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    cells = lambda c: F.concat(F.lit("| "), F.array_join(c, " | ", ""), F.lit(" |"))
    # A table begins where the line before isn't the row before (or the rule under the header).
    d = df.withColumn("__new", F.coalesce((F.col("line") - F.lag("line").over(w) > 1) | ~F.col("header").eqNullSafe(F.lag("header").over(w)), F.lit(True)))
    d = d.withColumn("table", F.sum(F.col("__new").cast("int")).over(w))
    t = Window.partitionBy(*keys, "table")
    d = d.withColumns({"__n": F.row_number().over(t.orderBy("line")), "__all": F.count("*").over(t)}).where(F.col("__all") >= least)
    g = d.groupBy(*keys, "table", F.floor((F.col("__n") - 1) / size).alias("__lot")).agg(F.min("__n").cast("long").alias("first"), F.max("__n").cast("long").alias("last"), F.count("*").alias("n_rows"), F.first("header").alias("h"), F.array_sort(F.collect_list(F.struct("__n", cells(F.col("cells")).alias("c")))).alias("rows"))
    return g.select(*keys, "table", "first", "last", "n_rows", F.concat(cells(F.col("h")), F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["c"]), "\n")).alias("text"))


def quoted(c: Column, patterns: dict[str, str]) -> list[Column]:
    """For each named pattern a column with its first match in a text, null if there is none."""
    return [F.when(F.rlike(c, F.lit(p)), F.trim(F.regexp_extract(c, f"({p})", 1))).alias(n) for n, p in patterns.items()]


def stated(df: DataFrame, keys: list[str], text: str, shapes: dict[str, tuple[str, dict[str, int]]]) -> DataFrame:
    """(keys, family, one column per field): what sentences of the given shapes state, every match a row.

    shapes: family -> (pattern, {field: group}); fields that a family lacks are null.
    """
    fields = list(dict.fromkeys(f for _, g in shapes.values() for f in g))
    none = F.lit(None).cast("string")

    def matches(family: str) -> Column:
        pattern, groups = shapes[family]
        zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f) for f, k in groups.items()])
        return F.transform(zipped, lambda x: F.struct(F.lit(family).alias("family"), *[(x[f] if f in groups else none).alias(f) for f in fields]))

    found = [matches(family) for family in shapes]
    return df.where(F.col(text).isNotNull()).select(*keys, F.explode(F.concat(*found)).alias("__x")).select(*keys, "__x.*")

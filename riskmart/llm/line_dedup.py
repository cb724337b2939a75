"""Line dedup by an exact set-similarity join (native).

A line is the set of its words. Words are ordered by rarity, and lines are candidates
when their prefixes, the rarest words, meet under the prefix, positional and length
filters and the bitmaps of their words leave room for enough shared ones; the Jaccard
similarity of the whole sets decides. Of two similar lines the later one, by document id
and line number, is removed; equal lines are the simplest case. Lines are judged on the
input, not on what is left.

One similar earlier line is enough to remove a line. So each line first meets, for the
first and the last few words of its prefix, the earliest line with that word; only lines
that this doesn't remove meet all earlier ones. A group of thousands of variants costs pairs in proportion to it.

Rarity comes from the whole corpus: words are counted in a fixed number of hash buckets
(``BUCKETS``, a byte each), so the table of rarity classes that every task gets never grows. A word's
sort key is its bucket's class followed by 57 bits of its hash, which puts rare words
first; 31 bits of it stand for the word where prefixes meet. All of it is DataFrame operations.

A line's text travels only where a candidate needs it: what a small set of keys
can't want is told by a bitmap of the set (``apart``), and is not shuffled.

Defined results: NULL, empty and blank texts have no lines, and blank lines are never
removed. Rows without an id have no place in the order: they lose nothing and take
nothing. Rows that repeat an id share their places: they don't take each other's line at
the same place. Other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import BLANKS, once, stored, table

BITS = 20
BUCKETS = 1 << BITS
PERCENT = 80
#: so many of the last words of a prefix, beside the first, look for their earliest line
LAST_WORDS = 2
#: lines of more words have a second bitmap
LONG = 64
#: more lines than a text can have
SPAN = 1 << 31
#: bits by which ``apart`` knows a set of keys; every executor gets up to 64 of them in a row
KNOWN_BITS = 1 << 24


def apart(frame: DataFrame, key: Column, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in ``some``, a frame of one column, and those whose key
    certainly isn't. Nothing of ``frame`` is shuffled for it."""

    def bit(column: Column) -> Column:
        return F.xxhash64(column).bitwiseAND(F.lit(KNOWN_BITS - 1))

    def in_word(column: Column) -> Column:
        return bit(column).bitwiseAND(F.lit(63)).cast("int")

    member = F.col(some.columns[0])
    known = some.groupBy(F.shiftright(bit(member), 6).alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), in_word(member))).alias("__known"))
    met = frame.join(F.broadcast(known), F.shiftright(bit(key), 6) == F.col("__word"), "left")
    hit = F.call_function("shiftrightunsigned", F.col("__known"), in_word(key)).bitwiseAND(F.lit(1))
    met = met.withColumn("__known", F.coalesce(hit, F.lit(0)) == 1).drop("__word")
    return met.filter("__known").drop("__known"), met.filter("not __known").drop("__known")


def marked(frame: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """The rows with ``gone``, whether their key is one of the different ones in ``some``."""
    maybe, others = apart(frame, F.col(key), some)
    found = maybe.join(some.toDF("__key"), F.col(key) == F.col("__key"), "left")
    return found.withColumn("gone", F.col("__key").isNotNull()).drop("__key").union(
        others.withColumn("gone", F.lit(False)))


def lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``pos``, ``line`` and its 96-bit fingerprint for lines with a word."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("doc_id is not null")
    d = d.select("doc_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    d = d.filter(F.length(F.btrim("line", F.lit(BLANKS))) > 0)
    return d.select("doc_id", "pos", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"),
                    place_of(documents, id_col).alias("place"))


def place_of(documents: DataFrame, id_col: str) -> Column:
    """A number for ``doc_id`` and ``pos`` that orders lines: a long where the range of
    ids leaves room for it (it takes half of the room in shuffles), else a decimal."""
    id_ = F.col(id_col).cast("long")
    low, high = documents.agg(F.min(id_), F.max(id_)).head()
    if low is None or (high - low + 1) * SPAN < 1 << 63:
        return (F.col("doc_id") - F.lit(low or 0)) * F.lit(SPAN) + F.col("pos").cast("long")
    return (F.col("doc_id").cast("decimal(20,0)") * SPAN + F.col("pos")).cast("decimal(31,0)")


def split_line(line: Column) -> Column:
    """The words of a line, and empty strings where blanks meet. Splitting at a single
    space needs no regular expression, so the other blanks become spaces first."""
    for blank in BLANKS[1:]:
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.split(line, " ")


def word_hashes(line: Column) -> Column:
    """The hashes of the different words of a line."""
    hashes = F.array_distinct(F.transform(split_line(line), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def rarity_classes(documents: DataFrame, text_col: str) -> np.ndarray:
    """For each hash bucket a class from 0 to 63 that grows with the logarithm of how
    often its words occur. They come to the driver as text, 1024 buckets a row: four
    hexadecimal digits for the bucket in its row and two for its class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    word = documents.select(F.explode(once(split_line(text))).alias("w")).filter("w <> ''")
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
    of_bucket = F.least(F.lit(63), F.floor(2.5 * F.log2(1 + F.col("count"))).cast("int"))
    code = F.concat(F.lpad(F.hex(F.col("bucket").bitwiseAND(F.lit(1023))), 4, "0"),
                    F.lpad(F.hex(of_bucket), 2, "0"))
    rows = counts.groupBy(F.shiftright("bucket", 10).alias("block")).agg(
        F.array_join(F.collect_list(code), "").alias("codes"))
    classes = np.zeros(BUCKETS, np.uint8)
    for block, codes in rows.collect():
        told = np.frombuffer(bytes.fromhex(codes), np.uint8).reshape(-1, 3).astype(np.int64)
        classes[1024 * block + 256 * told[:, 0] + told[:, 1]] = told[:, 2]
    return classes


def distinct_lines(found: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """The different lines, as a written table without their texts: fingerprint, the
    ``place`` a line first stands at, its number of ``copies``, the number ``n`` of its
    words, their ``bitmap`` and its ``prefix``, as 31 bits of each word's hash.

    A bit of the bitmap says whether an odd number of words fall on it, so two bitmaps
    differ in no more bits than their lines in words. ``half`` is the bitmap of about half
    of the words (0 for a line of up to ``LONG``); with it, the two halves tell more."""
    # an array in the plan, as looking up one of its elements is cheap
    # (written as JSON without an object for each number, which would fill the driver)
    digits = np.stack([classes // 10 + 48, classes % 10 + 48, np.full_like(classes, 44)], axis=1)
    digits[classes < 10, 0] = 32
    table_of = F.from_json(F.lit(f"[{digits.tobytes()[:-1].decode()}]"), "array<tinyint>")

    def key(h: Column) -> Column:
        of_bucket = F.get(table_of, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
        return F.shiftleft(of_bucket, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    none = F.lit(0).cast("long")

    def flipped(bits: Column, k: Column, one: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int")))

    bitmap = F.aggregate("keys", none, lambda bits, k: flipped(bits, k, F.lit(1).cast("long")))
    half = F.aggregate("keys", none, lambda bits, k: flipped(
        bits, k, F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long"))))

    d = found.select("h1", "h2", "place", once(F.sort_array(F.transform(
        once(word_hashes(F.col("line"))), key))).alias("keys"))
    n = F.size("keys")
    need = F.floor((n * percent + 99) / 100).cast("int")
    prefix = F.transform(F.slice("keys", F.lit(1), n - need + 1),
                         lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    d = d.select("h1", "h2", "place", n.alias("n"), prefix.alias("prefix"),
                 bitmap.alias("bitmap"), F.when(n > LONG, half).otherwise(none).alias("half"))
    return stored(d.groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("bitmap").alias("bitmap"), F.first("half").alias("half"), F.first("prefix").alias("prefix")), "distinct-lines")


def similar(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those pairs of places (``x``, ``y``) whose lines are similar, as ``x``."""
    pairs = stored(pairs, "line-pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("place"))
    line, _ = apart(found.select("place", "line"), F.col("place"), wanted)
    both = pairs.select("x", "y").join(line.toDF("y", "line_y"), "y")
    # the same columns on both sides, so that one exchange of the lines serves both
    both = both.join(line.toDF("x", "line_x"), "x")
    both = both.select("x", *(once(word_hashes(F.col(f"line_{s}"))).alias(s + "_words") for s in "xy"))
    shared = F.size(F.array_intersect("x_words", "y_words"))
    return both.filter(shared * (100 + percent) >= (F.size("x_words") + F.size("y_words")) * percent).select(
        "x").distinct()


def later_lines(distinct: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``x``: the places of those different lines that are similar to an earlier one.
    ``found`` has the text of every place."""

    def rows(lines: DataFrame, s: str) -> DataFrame:
        """A row for each word of a prefix; its place there shares a long with the size."""
        lines = lines.select(F.col("place").alias(s), "n", F.col("bitmap").alias(f"bits_{s}"),
                             F.col("half").alias(f"half_{s}"), F.posexplode("prefix").alias("i", "key"))
        at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long"))
        return lines.select("key", s, f"bits_{s}", f"half_{s}", at.alias(f"at_{s}"))

    def told(pairs: DataFrame, s: str) -> DataFrame:
        return pairs.withColumns({f"n_{s}": F.shiftright(f"at_{s}", 32).cast("int"),
                                  f"i_{s}": F.col(f"at_{s}").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})

    def alike(n_x: Column, n_y: Column) -> Column:
        """Whether sizes and bitmaps leave it open that two lines are similar."""
        one, two = (F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y")) for b in ("bits", "half"))
        apart_by = F.when(F.least(n_x, n_y) > LONG, F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two)).otherwise(
            F.bit_count(one))
        return (n_x * 100 >= n_y * percent) & (n_y * 100 >= n_x * percent) & (
            (n_x + n_y - apart_by) * (100 + percent) >= (n_x + n_y) * 2 * percent)

    def fits(n_x: Column, n_y: Column) -> Column:
        ahead = F.least(n_x - F.col("i_x"), n_y - F.col("i_y"))
        # the first shared word of a similar pair leaves enough words after it
        return alike(n_x, n_y) & (ahead * (100 + percent) >= (n_x + n_y) * percent)

    # the rarest word, which a pair of copies may have for itself, and the most frequent
    # words of the prefix, which changes made to one copy of many leave alone
    length = F.col("n_x") - F.ceil(F.col("n_x") * percent / 100).cast("int") + 1
    every = told(rows(distinct, "x"), "x").filter(
        (F.col("i_x") == 0) | (F.col("i_x") >= length - LAST_WORDS)).select(
            "key", "x", "n_x", "bits_x", "half_x")
    earliest = every.groupBy("key").agg(
        F.min("x").alias("y"), *(F.min_by(f"{c}_x", "x").alias(f"{c}_y") for c in ("n", "bits", "half")),
        F.count("*").alias("lines")).filter("lines > 1").drop("lines")
    stars = every.join(earliest, "key").filter(
        (F.col("y") < F.col("x")) & alike(F.col("n_x"), F.col("n_y")))
    first = stored(similar(stars.select("x", "y").distinct(), found, percent), "later-lines")
    # both sides are the same rows, so that one exchange of the prefixes serves both; the
    # size of a line that is gone is marked by its sign
    left = marked(distinct.select("place", "prefix", "bitmap", "half", "n"), "place", first).withColumn(
        "n", F.when(F.col("gone"), -F.col("n")).otherwise(F.col("n")))
    # the optimizer finds out that y is never null and would filter one side only
    left = left.filter("place is not null")
    pairs = told(told(rows(left, "x").join(rows(left, "y"), "key"), "x"), "y").filter(
        (F.col("y") < F.when(F.col("n_x") > 0, F.col("x"))) & fits(F.abs("n_x"), F.abs("n_y")))
    return stored(first.union(similar(pairs.select("x", "y").distinct(), found, percent)), "all-later-lines")


def removed_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  percent: int = PERCENT) -> DataFrame:
    """``doc_id`` and ``removed``, the sorted numbers of its later lines, for documents
    that have any."""
    found = lines(documents, id_col, text_col)
    distinct = distinct_lines(found, rarity_classes(documents, text_col), percent)
    later = later_lines(distinct, found, percent)
    first = distinct.select("h1", "h2", F.col("place").alias("first"), "copies").join(
        later.withColumn("later", F.lit(True)), F.col("first") == F.col("x"), "left").filter(
        F.col("later").isNotNull() | (F.col("copies") > 1)).drop("x", "copies")
    places = found.select("doc_id", "pos", "place", "h1", "h2").join(first, ["h1", "h2"])
    gone = places.filter(F.col("later").isNotNull() | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_lines`` (with a word),
    ``n_removed`` and ``removed``, the numbers of the removed lines from 0."""
    text = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    counts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.size(F.filter(text, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)).cast("long").alias("n_lines"))
    gone = removed_lines(documents, id_col, text_col, percent)
    none = F.array().cast("array<int>")
    return counts.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("removed", none)).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def remove_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 percent: int = PERCENT) -> DataFrame:
    """The documents without later lines, in their own columns; ``n_chars`` follows the
    text. A document that loses its last word goes."""
    gone = removed_lines(documents, id_col, text_col, percent).toDF("__id", "__removed")
    packed = documents.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("__own"))
    joined = packed.join(gone, F.col("__own") == F.col("__id"), "left")
    parts = F.split(F.col(f"row.`{text_col}`"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__removed"))
    joined = joined.withColumns({"__parts": once(parts), "__left": left})
    text = F.when(F.col("__removed").isNull(), F.col(f"row.`{text_col}`")).otherwise(
        F.array_join(F.transform("__left", lambda i: F.get(F.col("__parts"), i)), "\n"))
    joined = joined.withColumn("__text", once(text)).filter(
        F.col("__removed").isNull() | (F.length(F.btrim("__text", F.lit(BLANKS))) > 0))
    fresh = {text_col: F.col("__text")}
    if "n_chars" in documents.columns:
        fresh["n_chars"] = F.when(F.col("__removed").isNull(), F.col("row.n_chars")).otherwise(
            F.length("__text").cast("long"))
    return joined.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).withColumn(
        "removed", F.array_join(F.col("removed").cast("array<string>"), ","))


ORACLE = r"""
with l as (select doc_id, pos, line from (
             select doc_id, unnest(t) as line, generate_subscripts(t, 1) - 1 as pos
             from (select doc_id, string_split(coalesce(text, ''), chr(10)) as t from documents))
           where regexp_matches(line, '[^\x20\x09-\x0D]')),
u as (select row_number() over (order by doc_id, pos) as id, * from
      (select line, doc_id, pos from l qualify row_number() over (partition by line order by doc_id, pos) = 1)),
w as (select distinct id, x from (select id, unnest(string_split_regex(line, '[\x20\x09-\x0D]+')) as x from u) where x <> ''),
n as (select id, count(*) as n from w group by id),
f as (select x, count(*) as df from w group by x),
p as (select w.id, x, n, row_number() over (partition by w.id order by df, x) as r from w join f using (x) join n on n.id = w.id),
s as (select * from p where r <= n - ((n * 80 + 99) // 100) + 1),
c as (select distinct a.id as a, b.id as b from s a join s b on a.x = b.x and a.id < b.id
      where a.n * 100 >= b.n * 80 and b.n * 100 >= a.n * 80),
j as (select a, b, count(*) as k from c join w x on x.id = a join w y on y.id = b and y.x = x.x group by all),
later as (select distinct b as id from j join n x on x.id = a join n y on y.id = b where k * 180 >= (x.n + y.n) * 80),
gone as (select l.doc_id, l.pos from l join u using (line) left join later on later.id = u.id
         where later.id is not null or l.doc_id <> u.doc_id or l.pos <> u.pos),
g as (select doc_id, count(*) as n, string_agg(cast(pos as varchar), ',' order by pos) as s from gone group by doc_id),
t as (select doc_id, count(*) as n from l group by doc_id)
select d.doc_id, cast(coalesce(t.n, 0) as bigint) as n_lines, cast(coalesce(g.n, 0) as bigint) as n_removed, coalesce(g.s, '') as removed
from documents d left join t using (doc_id) left join g using (doc_id)"""

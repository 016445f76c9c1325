"""Line dedup by a deletion-neighbourhood join.

Two lines are the same if they differ by at most one word put in, left out or
replaced, where the longer has at least five words; otherwise only if equal. Of such
lines the earliest stays.

Every distinct line emits the hashed keys, of 128 bits, of its variants with one word deleted. A
replacement shows as an equal variant at an equal position, so all lines of that key
are within one edit of each other; a word put in or left out shows as a variant equal
to a whole line. For each key the earliest line is enough, so no pairs of a group are
formed, and groups are pre-aggregated. The pair of a line and the earliest of its key
is verified on the words themselves.

Before that, lines that cannot have a partner are set aside without loss: one edit
lies in one part of a line and leaves the words before and behind that part as they are,
so a line that shares them with no other line, whichever the part, has none. Two parts
are tried on every line, sixteen on those that remain.

The same holds with characters in place of words (unit="character").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.shared import stored, table

SPACE = r"[\x20\x09-\x0D]+"
_OTHER_SPACES = "\t\n\x0b\f\r"
#: Words of the longer line from which an edit of one word counts as the same line.
MIN_WORDS = 5
#: Parts of a line one of which holds the edit: of every line first, then of those that remain.
COARSE, FINE = 2, 16


def _normal(line: Column, unit: str = "word") -> Column:
    """The line's words with one space between them, or its characters, in which a unit separator stands for the space between words."""
    # most lines need no replacement, and searching them for what it would replace is far cheaper
    uneven = F.lit(False)
    for space in ("  ", *_OTHER_SPACES):
        uneven |= F.contains(line, F.lit(space))
    words = F.trim(F.when(uneven, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return words if unit == "word" else F.trim(F.regexp_replace(F.translate(words, " ", "\x1f"), "(.)", "$1 "))


def _count(normal: Column) -> Column:
    return (F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).cast("int")


def _digest(normal: Column) -> Column:
    return F.unhex(F.md5(normal.cast("binary")))


def _part_keys(parts: int, least: int) -> Column:
    """Hashes of a line's words without one part of it, for each part and for a longer line of as many words or of one more.

    One edit lies within one part of the longer line; the words before and behind that part are the same in both lines.
    """
    n = F.col("_n")
    keys = []
    for m in (n, n + 1):
        for k in range(parts):
            before, behind = F.floor(m * k / parts).cast("int"), (m - F.floor(m * (k + 1) / parts)).cast("int")
            sides = [F.call_function("substring_index", F.col("_normal"), F.lit(" "), x) for x in (before, -behind)]
            keys.append(F.xxhash64(m, F.lit(k), *sides))
    return F.when(n >= least, F.array(*keys)).when(n + 1 >= least, F.array(*keys[parts:])).otherwise(F.array().cast("array<bigint>"))


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int, unit: str) -> DataFrame:
    """(id, text_hash, no, _digest, _keys) of every line that has words."""
    text = F.col(text_col).cast("string")
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("no", "_line"))
    df = df.select("id", "text_hash", "no", _normal(F.col("_line"), unit).alias("_normal")).where("_normal <> ''")
    df = df.withColumn("_n", _count(F.col("_normal")))
    return df.select("id", "text_hash", "no", _digest(F.col("_normal")).alias("_digest"), _part_keys(COARSE, least).alias("_keys"))


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (_digest, _key, ...) whose key another line has too; a line has a key once."""
    return keys.join(keys.groupBy("_key").agg(F.count("*").alias("_m")).where("_m > 1").select("_key"), "_key")


def _place() -> Column:
    """A line's place in the order of all lines."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "no")


def _variants(lines: DataFrame, least: int) -> DataFrame:
    """(_k0, _k1, _kind, _pos, _digest): the variants of a line (_words, _n) with a word of one of its shared parts deleted, and the line itself. Kinds: r replaced, w whole, d deleted.

    A sequence of words is hashed as the exclusive or of the hashes of (word, position), so
    a deletion needs the running values only. They come from a window over the line's words, in
    time in proportion to the line; two such hashes make a key.
    """
    n, i = F.col("_n"), F.col("_i")
    words = lines.select("_pos", "_digest", "_n", "_parts", F.posexplode("_words").alias("_i", "_w"))
    lanes = {f"_h{k}{d}": F.xxhash64(F.lit(k), F.col("_w"), i - d) for k in (0, 1) for d in (0, 1)}
    # the first FINE parts are those of a longer line of as many words; a line too short for them has the others only
    part = F.ceil((i + 1) * FINE / n).cast("int") - 1
    words = words.withColumns({**lanes, "_own": (n >= least) & F.array_contains("_parts", part)}).drop("_w", "_parts")
    line = Window.partitionBy("_digest")
    upto = line.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumns({f"{x}_upto": F.bit_xor(x).over(upto) for x in lanes} | {f"{x}_all": F.bit_xor(x).over(line) for x in lanes})
    c = F.col

    def key(kind, name, *of):
        return F.struct(F.lit(kind).alias("kind"), *[F.xxhash64(F.lit(name), F.lit(k), *(f(k) if callable(f) else f for f in of)).alias(f"k{k}") for k in (0, 1)])

    replaced = key("r", "r", n, i, lambda k: c(f"_h{k}0_all").bitwiseXOR(c(f"_h{k}0")))
    deleted = key("d", "d", n - 1, lambda k: c(f"_h{k}0_upto").bitwiseXOR(c(f"_h{k}0")).bitwiseXOR(c(f"_h{k}1_all")).bitwiseXOR(c(f"_h{k}1_upto")))
    whole = key("w", "d", n, lambda k: c(f"_h{k}0_all"))
    keys = F.array_compact(F.array(F.when(c("_own"), replaced), F.when(c("_own"), deleted), F.when(i == n - 1, whole)))
    df = words.select("_pos", "_digest", F.explode(keys).alias("_k"))
    return df.select("_pos", "_digest", F.col("_k.k0").alias("_k0"), F.col("_k.k1").alias("_k1"), F.col("_k.kind").alias("_kind"))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one word put in, left out or replaced."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False), F.lit(0)) - 1, short)
    return (same(a, b) + same(F.reverse(a), F.reverse(b)) >= long - 1) & (long - short <= 1)


def find_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, unit: str = "word") -> DataFrame:
    """(id, text_hash, no, verdict) of every line with words: verdict is keep, repeated (an equal line is earlier) or near (an earlier line is one edit away).

    An edit puts in, leaves out or replaces one ``unit``, word or character, where the longer line has at least ``least`` of them. For
    characters the white space between two words counts as one, and U+001F as white space.

    Lines end at line feeds and words at ASCII white space. Lines are in the order of the documents' ids, null
    last, then of the texts' hashes and of their numbers. A text without line feeds is one line; a very long line takes time in proportion to its words. A line goes if any line within one edit is earlier, even if that
    one goes as well. Rows equal in id and text are one document. Lines without words are not listed. Null texts have no lines.
    Other columns are not read, so none can clash. An empty table gives an empty one.
    """
    slim = stored(_lines(docs, id_col, text_col, least, unit))
    first = stored(slim.groupBy("_digest").agg(F.min(_place()).alias("_first"), F.count("*").alias("_rows"), F.any_value("_keys").alias("_keys")))
    able = _shared(first.select("_digest", F.explode("_keys").alias("_key"))).select("_digest").distinct().join(first.select("_digest", "_first"), "_digest")
    # the words of those lines: texts meet the line numbers that are asked of them, so whole texts move once
    asked = able.groupBy("_first.id", "_first.text_hash").agg(F.collect_set("_first.no").alias("_nos"))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    text = text.join(asked, F.col("_id").eqNullSafe(F.col("id")) & (F.xxhash64("_text") == F.col("text_hash")))
    text = text.select("id", "text_hash", F.explode("_nos").alias("no"), F.split("_text", "\n").alias("_lines"))
    words = text.select(_place().alias("_pos"), _normal(F.get("_lines", F.col("no")), unit).alias("_normal"))
    words = words.select("_pos", "_normal", _count(F.col("_normal")).alias("_n"), _digest(F.col("_normal")).alias("_digest"))
    words = stored(words.dropDuplicates(["_digest"]))
    parts = _shared(words.select("_digest", F.posexplode(_part_keys(FINE, least)).alias("_part", "_key"))).groupBy("_digest").agg(F.sort_array(F.collect_set("_part")).alias("_parts"))
    texts = stored(words.join(parts, "_digest").select("_pos", "_digest", "_n", "_parts", F.split("_normal", " ").alias("_words")))
    variants = stored(_variants(texts, least))
    at = lambda kind: F.min(F.when(F.col("_kind") == kind, F.struct("_pos", "_digest"))).alias(f"_{kind}")
    groups = variants.groupBy("_k0", "_k1").agg(F.count("*").alias("_m"), at("r"), at("w"), at("d")).where((F.col("_m") > 1) & (F.col("_r").isNotNull() | (F.col("_w").isNotNull() & F.col("_d").isNotNull())))
    met = variants.join(groups.drop("_m"), ["_k0", "_k1"])
    earlier = F.when(F.col("_kind") == "r", F.col("_r")).when(F.col("_kind") == "d", F.col("_w")).otherwise(F.col("_d"))
    pairs = met.withColumn("_e", earlier).where(F.col("_e._pos") < F.col("_pos")).select("_digest", F.col("_e._digest").alias("_other")).distinct()
    words = texts.select("_digest", "_words")
    checked = pairs.join(words, "_digest").join(words.select(F.col("_digest").alias("_other"), F.col("_words").alias("_theirs")), "_other")
    near = checked.where(_within_one(F.col("_words"), F.col("_theirs"))).select("_digest").distinct().withColumn("_near", F.lit(True))
    marked = stored(first.where("_rows > 1").select("_digest", "_first").join(near, "_digest", "full"))
    out = slim.select("id", "text_hash", "no", "_digest").join(marked, "_digest", "left")
    verdict = F.when(F.col("_first").isNotNull() & ~_place().eqNullSafe(F.col("_first")), "repeated").when(F.col("_near"), "near").otherwise("keep")
    return out.select("id", "text_hash", "no", verdict.alias("verdict"))


def _by_document(found: DataFrame) -> DataFrame:
    one = lambda v: F.count_if(F.col("verdict") == v)
    gone = F.sort_array(F.collect_set(F.when(F.col("verdict") != "keep", F.col("no"))))
    return found.groupBy("id", "text_hash").agg(F.count_distinct("no").alias("n_lines"), one("repeated").alias("n_repeated"), one("near").alias("n_near"), gone.alias("gone"))


_OWN = ("n_lines", "n_repeated", "n_near", "gone")


def _counted(docs: DataFrame, id_col: str, text_col: str, per_doc: DataFrame) -> DataFrame:
    """(d: the rows of ``docs``, and their counts): a document without lines has none."""
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col(text_col).cast("string"))).alias("d")
    out = keyed.join(per_doc.alias("l"), F.col(f"d.{id_col}").eqNullSafe(F.col("l.id")) & (F.col("d._text_hash") == F.col("l.text_hash")), "left")
    none = {"gone": F.array().cast("array<int>")}
    return out.select("d.*", *[F.coalesce(F.col(f"l.{c}"), none.get(c, F.lit(0))).alias(f"_{c}") for c in _OWN])


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with n_lines (with words), n_repeated, n_near and gone (numbers of the lines to drop, from 0), and clean_text without them.

    Further arguments are those of find_repeated_lines. Every row of ``docs`` has a row; equal rows have equal ones. Input columns
    named like a result column give way to it. Lines without words stay. A null text stays null. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in (*_OWN, "clean_text")]
    out = _counted(docs.select(*kept), id_col, text_col, _by_document(find_repeated_lines(docs, id_col=id_col, text_col=text_col, **kw)))
    lines = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x, i: ~F.array_contains("_gone", i))
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in _OWN], F.array_join(lines, "\n").alias("clean_text"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: its lines with words, those that repeat, those one edit from an earlier one, and the numbers of those to drop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _counted(docs, "doc_id", "text", _by_document(find_repeated_lines(docs)))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in _OWN[:3]], F.array_join("_gone", ",").alias("dropped"))


ORACLE_OP8 = r"""
WITH l AS (
  SELECT doc_id, no - 1 AS no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
), p AS (
  SELECT *, len(w) AS n, md5(array_to_string(w, ' ')) AS g, doc_id * 1000000 + no AS pos FROM l WHERE len(w) > 0
), f AS (
  SELECT g, min(pos) AS pos, any_value(w) AS w, any_value(n) AS n FROM p GROUP BY g
), v AS (
  SELECT g, pos, n, i, md5(array_to_string(list_concat(w[1 : i - 1], w[i + 1 : n]), ' ')) AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)
), near AS (
  SELECT g FROM (SELECT g, pos > min(pos) OVER (PARTITION BY n, i, k) AS x FROM v) WHERE x
  UNION SELECT v.g FROM v JOIN f ON v.k = f.g WHERE f.pos < v.pos
  UNION SELECT f.g FROM v JOIN f ON v.k = f.g WHERE v.pos < f.pos
), j AS (
  SELECT p.doc_id, p.no, CASE WHEN p.pos <> f.pos THEN 'repeated' WHEN near.g IS NOT NULL THEN 'near' ELSE 'keep' END AS verdict
  FROM p JOIN f USING (g) LEFT JOIN near USING (g)
)
SELECT d.doc_id, count(no)::BIGINT AS n_lines, count(*) FILTER (verdict = 'repeated')::BIGINT AS n_repeated, count(*) FILTER (verdict = 'near')::BIGINT AS n_near,
  coalesce(string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (verdict <> 'keep'), '') AS dropped
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""

"""Secret scans: candidates by pattern, a random forest against false positives.

Candidates are all long runs of key-like characters and values assigned to names such as
password or token; nothing but the forest decides on them. Each gets features of its own characters (length, classes,
entropy), of its transitions from character to character (how likely they are among labelled secrets, among labelled
other findings, and among the words of the corpus), of the dictionary (how much of it known words cover), of the path it
stands in, and of the words around it. A random forest, trained from labelled findings, scores them.

The dictionary is counted over all documents. Tables of transitions have a fixed size.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.shared import broadcast_if_small, checkpointed, stored, table

_MARK = "\x01"
#: Characters an assigned value has at least, those of a run without a name, and blanks on each side of the sign at most.
LEAST_VALUE, LEAST_RUN, BLANKS = 8, 16, 3
_KEY = "[A-Za-z0-9+/_=-]"


def assigned_pattern(least: int = LEAST_VALUE, blanks: int = BLANKS) -> str:
    """A name with its sign, which may end a longer name, and the whole value up to white space, a quote or an angle bracket."""
    return rf"((?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{{0,{blanks}}}[=:][ \t]{{0,{blanks}}}[\"']?)([^\s\"'<>\x01]{{{least},}})"


def run_pattern(assigned: str, least: int = LEAST_RUN) -> str:
    """A run of key-like characters, and what follows a point if it is as long; a run that holds a name with a value is left to the name."""
    plain = assigned.replace("((?i:", "(?:(?i:", 1).replace(")([^", ")(?:[^", 1)
    return rf"(?<!{_KEY})(?={_KEY}{{{least}}})(?!{_KEY}*?{plain})({_KEY}{{{least},}}(?:\.{_KEY}{{{least},}})*)"


_ASSIGNED = assigned_pattern()
_RUN = run_pattern(_ASSIGNED)
BEFORE, AFTER = 64, 24
#: Labelled findings the forest may learn from.
SAMPLE = 20_000
TREES, DEPTH = 24, 8
THRESHOLD = 0.5
#: Documents that must hold a word for it to count as one.
DICTIONARY_DOCS = 5
#: Characters that have transitions of their own; all others count as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:"
_SIZE = len(ALPHABET) + 1


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_value: int = LEAST_VALUE, least_run: int = LEAST_RUN, blanks: int = BLANKS) -> DataFrame:
    """(id, start, before, candidate, after): start counts code points from 0. Texts with very many candidates take time in proportion.

    A value has ``least_value`` characters and a run without a name ``least_run`` at least; up to ``blanks`` blanks or tabs stand on each side of the sign between a name and its value.
    """
    assigned = assigned_pattern(least_value, blanks)
    marked = F.regexp_replace(F.translate(F.col(text_col).cast("string"), _MARK, " "), f"{assigned}|{run_pattern(assigned, least_run)}", f"$1{_MARK}$2$3{_MARK}")
    df = docs.select(F.col(id_col).alias("id"), F.split(marked, _MARK).alias("_p")).where(F.size("_p") > 1).withColumn("_row", F.monotonically_increasing_id())
    df = df.select("id", "_row", "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 2, F.lit(2))).alias("_i"))
    piece = lambda k: F.get("_p", F.col("_i") + k)
    df = df.select(
        "id", "_row", "_i", F.right(piece(-1), F.lit(BEFORE)).alias("before"), piece(0).alias("candidate"), F.left(piece(1), F.lit(AFTER)).alias("after"), F.length(piece(-1)).alias("_gap")
    )
    upto = F.sum(F.col("_gap") + F.length("candidate")).over(Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("start", (upto - F.length("candidate")).cast("int")).select("id", "start", "before", "candidate", "after")


def _subwords(candidate: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(candidate), F.lit(r"\p{L}{3,}"), 0))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, docs): words of at least three letters, in lower case, with the number of documents that hold them, from DICTIONARY_DOCS on."""
    pattern = F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}(?![\p{L}\p{N}_])")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), pattern, 0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= DICTIONARY_DOCS)


def _coverage(words: DataFrame, found: DataFrame) -> DataFrame:
    """(candidate, covered): characters of the candidate's words that the dictionary holds."""
    own = found.select("candidate").distinct().select("candidate", F.explode(_subwords(F.col("candidate"))).alias("word"))
    return own.join(words.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def _transitions(letters: Column) -> Column:
    """The numbers of the neighbouring pairs of a text's characters."""
    codes = F.transform(letters, lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes), F.lit(1))), lambda a, b: a * _SIZE + b), lambda p: p.isNotNull())


def _likelihoods(rows: DataFrame, name: str) -> DataFrame:
    """One row with an array: the logarithm of the probability of each transition among the texts (text, weight), given its first character. Unseen ones count half."""
    pairs = rows.select("weight", F.explode(_transitions(_letters(F.col("text")))).alias("p")).groupBy("p").agg(F.sum("weight").cast("double").alias("n"))
    every = rows.sparkSession.range(0, _SIZE * _SIZE, 1, 1).withColumnRenamed("id", "p")  # a table of fixed size
    every = every.join(pairs, "p", "left").fillna(0.0, ["n"])
    of = F.sum("n").over(Window.partitionBy(F.expr(f"p div {_SIZE}")))
    logs = every.select("p", F.round(F.log((F.col("n") + 0.5) / (of + 0.5 * _SIZE)), 9).alias("l"))
    return logs.agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "l"))), lambda x: x["l"]).alias(name))


def transition_tables(labelled: DataFrame, words: DataFrame) -> DataFrame:
    """One row (_secret, _other, _words): likelihoods of transitions among labelled secrets, other labelled findings, and the dictionary's words by their documents."""
    of = lambda label, name: _likelihoods(labelled.where(F.col("label") == label).select(F.col("candidate").alias("text"), F.lit(1).alias("weight")), name)
    tables = of(1.0, "_secret").crossJoin(of(0.0, "_other")).crossJoin(_likelihoods(words.select(F.col("word").alias("text"), F.col("docs").alias("weight")), "_words"))
    return checkpointed(tables)  # one row each


def _features() -> dict[str, Column]:
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    letters, pairs = F.col("_letters"), F.col("_pairs")
    # entropy from the runs of the sorted characters, so one pass is enough
    state = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    weigh = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(acc, x):
        same = acc["last"] == x
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + weigh(acc["run"])).alias("sum"))

    entropy = F.aggregate(F.array_sort(letters), state, step, lambda acc: F.log2(n) - (acc["sum"] + weigh(acc["run"])) / n)
    like = lambda table: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p)) / F.greatest(F.size(pairs), F.lit(1))
    near = lambda words: before.rlike(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])").cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "symbols": share("[^A-Za-z0-9]"),
        "like_secret": F.round(like("_secret"), 6),
        "like_other": F.round(like("_other"), 6),
        "like_words": F.round(like("_words"), 6),
        "distinct": F.size(F.array_distinct(letters)) / n,
        "entropy": F.round(entropy, 6),
        "covered": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "in_path": before.rlike(r"[\w.:/\\-]*[/\\]$").cast("double"),
        "in_url": before.rlike(r"https?://\S*$").cast("double"),
        "assigned": before.rlike(r"[=:][ \t]{0,3}[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "names_secret": near("password|passwd|pwd|secret|token|key|api|auth|bearer|credential|credentials|apikey|access"),
        "names_other": near("commit|sha|sha1|sha256|md5|checksum|hash|revision|uuid|guid|id|card|number|isbn|version|example|sample|test|dummy|placeholder"),
        "placeholder": F.lower(c).rlike("example|sample|your|dummy|changeme|placeholder|xxxx|test|0000|1234567").cast("double"),
    }


def with_features(found: DataFrame, words: DataFrame, tables: DataFrame) -> DataFrame:
    """Findings (before, candidate, after) with their features."""
    covered = checkpointed(_coverage(words, found))
    rows = found.join(broadcast_if_small(covered), "candidate", "left").crossJoin(F.broadcast(tables))  # one row
    # in steps of their own, so that each is worked out once
    rows = rows.withColumn("_letters", _letters(F.col("candidate"))).withColumn("_pairs", _transitions(F.col("_letters")))
    return rows.select(*found.columns, *[c.alias(k) for k, c in _features().items()])


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """(before, candidate, after, label): made-up findings, half of them secrets, as training data where no labelled ones are at hand."""
    df = spark.range(0, rows, 1, 1).withColumn("_h", F.sha2(F.col("id").cast("string"), 256))
    mixed = F.translate(F.base64(F.unhex("_h")), "+/=", "qZ7")
    digits = F.substring(F.conv(F.substring("_h", 1, 15), 16, 10), 1, 16)
    at = lambda k, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.expr(f"(id div {k}) % {len(xs)} + 1")).cast("int"))
    words = at(14, "the long way home", "read me first please", "list of all the things", "and that is how", "notes on the other side", "with from this and over")
    prose = at(7, "and then the ", "of which ", "see the file ", "for it was ", "lines of ", "as in ")
    h = F.col("_h")
    syllables = F.array(*map(F.lit, "ka lo mi ne ru ta si vo da per gun ha rit so en ber".split()))
    long_word = F.concat(*[F.get(syllables, F.conv(F.substring("_h", k, 1), 16, 10).cast("int")) for k in range(1, 10)])
    # forms of many lengths, so that no length stands for a kind
    upto = lambda least, more: F.left("_h", F.lit(least) + F.conv(F.substring("_h", 50, 2), 16, 10).cast("int") % more)
    secrets = [
        (at(7, "api_token: ", "api_key: \"", "the key = \"", "secret = '"), upto(24, 40), "\" "),
        (at(7, "aws_access_key_id = ", "key: ", "access key "), F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(mixed, 1, 16), "abc", "XYZ"))), "\n"),
        (at(7, "git clone with token ", "auth = \"", prose), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), " "),
        (at(7, "secret: ", "bearer ", "client_secret = \""), F.base64(F.unhex("_h")), "\" "),
        (at(7, "password = \"", "pwd: ", "passwd='"), F.concat(F.substring(mixed, 1, 9), F.lit("!"), F.substring(mixed, 11, 3)), "\" "),
        (at(7, "secret = \"", "api-key: ", "credentials "), F.col("_h"), "\" "),
        (at(7, "auth token ", "key=\"", prose), F.concat(F.lit("sk-"), F.substring(mixed, 1, 32)), " "),
        (at(7, "db_password=", "export ROOT_PASSWD=", "admin_pwd: "), F.concat(F.substring(mixed, 1, 4), F.lit("!"), F.substring(mixed, 5, 4), F.lit("$"), F.substring(mixed, 9, 4), F.lit("#"), F.substring(mixed, 13, 2)), " "),
        (at(7, "access_token=", "authorization: bearer ", prose), F.concat_ws(".", F.substring(mixed, 1, 20), F.reverse(F.substring(mixed, 8, 30)), upto(20, 30)), " "),
        (at(7, "password=", "login_pwd: ", "DB_PASSWORD=\""), F.concat(F.left(long_word, F.lit(7)), F.substring(digits, 1, 1), F.reverse(F.left(long_word, F.lit(5))), at(3, "!", "$", "@"), F.substring(long_word, 6, 6)), "\" "),
        (at(7, "client_secret=", "my_secret_token: ", "password='"), F.translate(F.substring(mixed, 1, 22), "0123456789", "KqWzRtPxYb"), "' "),
    ]
    others = [
        (at(7, "id ", "uuid: ", prose), F.concat_ws("-", *[F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), " "),
        (at(7, "commit ", "at revision ", "sha1 "), upto(16, 32), "\n"),
        (at(7, "see /var/", "https://example.com/", "images/"), F.concat(F.translate(words, " ", "-"), F.lit("/2021/image-"), F.substring(digits, 1, 4)), " "),
        (prose, at(3, digits, long_word, F.initcap(long_word)), " "),
        (prose, F.concat(F.translate(words, " ", "-"), F.lit("-"), F.substring(digits, 1, 4)), " "),
        (at(7, "md5: ", "checksum = ", "hash "), upto(24, 40), " "),
        (at(7, "token = ", "password = ", "secret: "), F.concat(F.translate(words, " ", "."), F.lit(".get_"), F.left(long_word, F.lit(6)), F.lit("()")), "\n"),
        (at(7, "the password: ", "no secret: ", "token: "), at(3, long_word, F.initcap(long_word), F.concat(F.left(long_word, F.lit(9)), F.lit(","))), " "),
        (prose, F.concat_ws(".", long_word, F.reverse(long_word)), " "),
        (at(7, "token=", "passwd: ", "secret_name="), F.concat(F.left(long_word, F.lit(6)), at(3, "-", "_", "."), F.lit("value"), at(3, "-", "_", "."), F.substring(long_word, 7, 5)), "\n"),
        (at(7, "token = \"", "password: ", "api_key = '"), at(21, F.lit("your-api-key-here-000"), F.lit("xxxxxxxxxxxxxxxx1"), F.lit("changeme-12345678"), F.lit("EXAMPLE0000000000"), F.translate(words, " ", "_")), "\" "),
    ]
    pick = lambda rows, j: F.element_at(F.array(*[r[j] if isinstance(r[j], Column) else F.lit(r[j]) for r in rows]), F.expr("cast(id % 11 + 1 as int)"))
    label = F.expr("cast((id div 11) % 2 as double)")
    both = lambda j: F.when(label == 1, pick(secrets, j)).otherwise(pick(others, j))
    return df.select(both(0).alias("before"), both(1).alias("candidate"), both(2).alias("after"), label.alias("label"))


def word_findings(words: DataFrame, rows: int = 600) -> DataFrame:
    """(before, candidate, after, label): runs of two or three of the dictionary's words, drawn by hash, which are no secrets."""
    drawn = words.select("word", F.xxhash64("word").alias("_h")).orderBy("_h", "word").limit(4 * rows)  # at most four words a row
    drawn = drawn.withColumn("_n", F.row_number().over(Window.orderBy("_h", "word")))
    runs = drawn.groupBy(F.expr("_n div 4").alias("_r")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]), "").alias("_w"))
    word = F.left(F.when(F.col("_r") % 3 == 0, F.initcap("_w")).when(F.col("_r") % 3 == 1, F.upper("_w")).otherwise(F.col("_w")), F.lit(16) + F.col("_r") % 9)
    runs = runs.select(F.lit("").alias("before"), word.alias("candidate"), F.when(F.col("_r") % 4 == 0, ". ").otherwise(" ").alias("after"), F.lit(0.0).alias("label"))
    return runs.where(F.col("candidate").rlike("^[A-Za-z]{16,}$"))


def find_secrets(
    docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, words: DataFrame | None = None, **lengths: int
) -> DataFrame:
    """(id, start, candidate, score, secret) for every candidate of every text.

    ``labelled`` has before, candidate, after and label (1 for a secret); at most ``sample`` of its
    rows, by hash, train the forest, and with them runs of the dictionary's own words as other findings. ``words`` is the dictionary if it is at hand. Null and empty texts have no candidates; a null id stays null;
    repeated rows give repeated findings. Other columns of ``docs`` are not read, so none clashes. A candidate of any length is one finding; ``lengths`` are those of candidates.
    An empty table gives no rows. Labels must be of both kinds.
    """
    found = checkpointed(candidates(docs, id_col=id_col, text_col=text_col, **lengths))
    known = labelled.select("before", "candidate", "after", F.col("label").cast("double").alias("label")).dropna()
    known = known.orderBy(F.xxhash64("before", "candidate", "after"), "candidate", "before").limit(sample)
    words = stored(dictionary(docs, text_col)) if words is None else words
    known = checkpointed(known.unionByName(word_findings(words)).coalesce(1))
    tables = transition_tables(known, words)
    features = list(_features())
    vector = VectorAssembler(inputCols=features, outputCol="features")
    train = with_features(known, words, tables).coalesce(1).sortWithinPartitions("before", "candidate", "after").select("label", *features)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="sqrt").fit(vector.transform(train))
    rows = with_features(found, words, tables).select("id", "start", "candidate", *features)
    scored = forest.transform(vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("id", "start", "candidate", F.round("score", 9).alias("score"), (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", **kw) -> DataFrame:
    """``docs`` with every secret replaced by ``mask`` in the text, wherever the same string stands in that document.

    Rows with a null id are one document, and so are those of an id that repeats: each of its rows loses the secrets of all. A secret that holds another goes first. A null text stays null,
    a text without secrets as it is. All columns stay, whatever their names, in order; an empty table gives an empty one.
    """
    found = find_secrets(docs, labelled, id_col=id_col, text_col=text_col, **kw).where("secret")
    per_doc = found.groupBy("id").agg(F.collect_set("candidate").alias("secrets"))
    longest = F.array_sort("f.secrets", lambda a, b: F.length(b) - F.length(a))
    out = docs.alias("d").join(per_doc.alias("f"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("f.id")), "left")
    clean = F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), F.col(f"d.`{text_col}`"), lambda t, s: F.replace(t, s, F.lit(mask)))
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score; the strings themselves stay out of the result."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), labelled_findings(spark))
    return found.select(
        F.col("id").alias("doc_id"), "start", F.length("candidate").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "secret"
    )

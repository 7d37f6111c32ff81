"""Secret scan with a random forest against false positives (operator 1), on DataFrame functions only.

Candidates are long runs of token characters (the value alone where a name is
assigned it within the word), whatever is assigned to a secret's name, however
short, and all lines of a private key block. A forest (pyspark.ml) judges each
by its length, the transitions between character classes, how much of it the
corpus dictionary covers (whole parts that are words of the corpus, and any
places of its most frequent words), the path it was found under and the words
around it. For an assignment within a word the word to the left is the name;
lines of a private key have the key's header to their left. No feature repeats
a condition that labels are made by.

It is trained on labelled findings: candidates with a 0/1 label. Without such a
table, those that a rule is certain of are learnt from: known key formats, key
blocks and named values are 1, plainly harmless runs (words, numbers, paths of
words, named checksums) and placeholders are 0; all others stay unlabelled, and
the forest alone decides on every candidate.

Words are counted over the whole corpus; a part of a candidate is known if
``WORD_ROWS`` documents have it. Findings are made distinct before the forest
is fitted on at most ``MAX_ROWS`` of each label (those with the least hash). The
log odds of paths, names and neighbouring words come from these rows too, so
they are bounded and broadcast; a row learnt from takes its odds from the half
of the rows that its own value isn't in, and a third of the rows are also learnt
from without any, so that forms among words never seen are judged by their shape.

Defined cases: a null or empty text has no candidates; null labels are not
learnt from; without findings of both labels every candidate gets the share of
positive ones (0 without any), or the rule's label (0 without one) where the
findings come from the rule; null paths and missing neighbours have log odds of
their own; repeated rows are scanned one by one; extra columns are ignored; an
empty table gives no rows; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work, in_training_fold

CANDIDATE = "[A-Za-z0-9_+/=-]{16,}"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Names that are given secrets as values, for findings labelled by rule.
_NAME = "[\\w.-]{0,64}(?:token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or))[\\w.-]{0,64}"
_ASSIGNED = "[\"'\\]]{0,2}(?::=|=>|[=:])(?![=:]|//)"
#: Names that are given secrets as values, for findings labelled by rule.
SECRET_NAME = f"(?i)^\\W*{_NAME}\\W*$"
_VALUE = "[^\\s\"'`,;&<>(){}\\[\\]]+"
#: A secret's name and its value, of any length, in one word; any name and a candidate in one word.
NAMED_VALUE = f"(?i)({_NAME}{_ASSIGNED})[\"'`]{{0,3}}({_VALUE})"
OTHER_VALUE = f"([A-Za-z_][\\w.-]{{0,64}}{_ASSIGNED})[\"'`]{{0,3}}({CANDIDATE})"
KNOWN_FORMAT = (
    "^(?:(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\\w{22,}|glpat-[\\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|"
    "[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[\\w-]{35}|npm_[A-Za-z0-9]{36}|eyJ[\\w-]{13,})$"
)
_PROSE = "^\\p{L}+[.!?:]*$"
_PLACEHOLDER = "(?i)^(?:\\$.*|%.*|null|none|nil|true|false|undefined|x+|\\*+|\\.+|(?:os|process)\\..*)$"
_HARMLESS = "^(?:[A-Za-z]?[a-z]+|[A-Z]+|[-_=+/0-9]+|/?[A-Za-z]?[a-z]+(?:[-_/][A-Za-z]?[a-z]*)+)$"
_CHECKSUM = "(?i)(?:sha\\d*|md5|commit|checksum|digest|integrity|etag|crc\\d*)\\W*$"
#: Most frequent words that are looked for anywhere in a candidate, and documents that make a part of it a known word.
DICTIONARY = 300
WORD_ROWS = 2
MAX_ROWS = 5_000
TREES = 20
DEPTH = 6
THRESHOLD = 0.5
MASK = "[SECRET]"

#: Classes of lower-cased characters, so that a form in capitals has the transitions of the same form without.
_CLASSES = {"v": "aeiouy", "c": "bcdfghjklmnpqrstvwxz", "d": "0123456789", "o": "_+/=-"}


def _named(left2: Column, left1: Column) -> Column:
    return left1.rlike("^\\W*[=:]\\W*$") & left2.rlike(SECRET_NAME) | left1.rlike(SECRET_NAME.replace("\\W*$", "[\"'\\]\\s]*[=:]+\\W*$"))


def _in_key(left2: Column, left1: Column) -> Column:
    return (left2 == "PRIVATE") & (left1 == "KEY-----")


def _values(left2: Column, left1: Column, x: Column, in_key: Column) -> Column:
    """(left2, left1, value) of every candidate in a word: the lines of a key, what is assigned in the word, other long runs."""

    def at(l2: Column, l1: Column, v: Column) -> Column:
        return F.struct(l2.alias("left2"), l1.alias("left1"), v.alias("value"))

    def assigned(word: Column, pattern: str) -> Column:
        return F.zip_with(F.regexp_extract_all(word, F.lit(pattern), F.lit(1)), F.regexp_extract_all(word, F.lit(pattern), F.lit(2)), lambda n, v: at(left1, n, v))

    def runs(word: Column) -> Column:
        return F.transform(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)), lambda v: at(left2, left1, v))

    rest = F.regexp_replace(x, NAMED_VALUE, " ")
    other = F.concat(assigned(x, NAMED_VALUE), assigned(rest, OTHER_VALUE), runs(F.regexp_replace(rest, OTHER_VALUE, " ")))
    quoted, bare = F.regexp_extract(x, "^[\"'`]+([^\"'`\\s]+)", 1), F.regexp_extract(x, f"({_VALUE}?)[.!?#$*]*(?:[\"'`,;&<>(){{}}\\[\\]]|$)", 1)
    whole = F.when(quoted != "", quoted).when(~x.rlike(CANDIDATE), bare).otherwise(F.lit(""))
    lines = F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9+/=]+"), F.lit(0)), lambda v: at(F.lit("PRIVATE"), F.lit("KEY-----"), v))
    named = F.coalesce(_named(left2, left1), F.lit(False)) & ~x.rlike(NAMED_VALUE)
    return F.when(in_key, lines).when(named & (whole != ""), F.array(at(left2, left1, whole))).otherwise(other)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, path, word_index, run (within the word), value and the words around it."""
    likely = F.col("text").rlike(f"{CANDIDATE}|PRIVATE KEY-----|(?i:{_NAME})[\"'`\\]\\s]{{0,4}}[=:]")
    words = docs.where(likely).select("doc_id", F.col("source").alias("path"), "text", F.split("text", SPACE).alias("w"))

    def word(i: Column, back: int) -> Column:
        return F.get("w", i - back)

    every = F.sequence(F.lit(0), F.size("w") - 1)
    begins = F.filter(every, lambda i: word(i, 0).startswith("KEY-----") & (word(i, 1) == "PRIVATE") & (word(i, 2).endswith("-----BEGIN") | word(i, 3).endswith("-----BEGIN") & ~word(i, 2).endswith("-----END")))
    ends = F.filter(every, lambda i: word(i, 0).contains("-----END"))
    none, key = F.array().cast("array<int>"), F.col("text").contains("PRIVATE KEY-----")
    words = words.withColumn("begins", F.when(key, begins).otherwise(none)).withColumn("ends", F.when(key, ends).otherwise(none))

    def in_key(i: Column) -> Column:
        begin = F.array_max(F.filter("begins", lambda b: b < i))
        return F.when(F.size("begins") == 0, False).otherwise(F.coalesce(begin > F.coalesce(F.array_max(F.filter("ends", lambda e: e <= i)), F.lit(-1)), F.lit(False)))

    def wanted(s: Column) -> Column:
        i, x = s["i"], s["x"]
        after = word(i, 1).rlike("[=:]") & _named(word(i, 2), word(i, 1))
        return x.rlike(CANDIDATE) | x.rlike(NAMED_VALUE) | F.coalesce(after, F.lit(False)) | in_key(i)

    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), wanted)
    c = words.select("doc_id", "path", F.explode(F.transform(hits, lambda s: F.struct(
        s["i"].alias("i"), word(s["i"], -1).alias("right1"), _values(word(s["i"], 2), word(s["i"], 1), s["x"], in_key(s["i"])).alias("found"),
    ))).alias("h"))
    c = c.select("doc_id", "path", F.col("h.i").cast("long").alias("word_index"), "h.right1", F.posexplode("h.found").alias("run", "v"))
    return c.select("doc_id", "path", "word_index", "v.left2", "v.left1", "right1", "run", "v.value")


def rule_label(words: list[str]) -> Column:
    """1 for known key formats, lines of private keys and named values, 0 for plainly harmless ones and words of the dictionary, else null."""
    value, left2, left1 = F.col("value"), F.col("left2"), F.col("left1")
    checksum = value.rlike("^[0-9a-fA-F]+$") & (left1.rlike(_CHECKSUM) | left1.rlike("^\\W*[=:]\\W*$") & left2.rlike(_CHECKSUM))
    word = F.regexp_replace(F.lower(value), "[.!?:]+$", "")
    common = value.rlike(_PROSE) & ((F.length(word) <= 3) | word.isin(words))
    return (
        F.when(value.rlike(KNOWN_FORMAT) | _in_key(left2, left1), 1)
        .when(_named(left2, left1), F.when(value.rlike(_PLACEHOLDER) | common, 0).when(~value.rlike(_PROSE), 1))
        .when(value.rlike(_HARMLESS) | checksum, 0)
    )


def labelled_by_rule(cands: DataFrame, words: list[str]) -> DataFrame:
    """Findings of the training fold that the rule decides."""
    return cands.where(in_training_fold(F.col("doc_id"))).withColumn("label", rule_label(words)).where("label IS NOT NULL")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the documents that hold each word of three letters or more."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda x: F.length(x) >= 3))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(counted: DataFrame) -> list[str]:
    """The words of 3 to 8 ASCII letters found in most documents."""
    short = counted.where(F.col("word").rlike("^[a-z]{3,8}$"))
    return [r["word"] for r in short.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()]


def with_known_parts(cands: DataFrame, counted: DataFrame, work: Work) -> DataFrame:
    """Candidates with ``f_parts``, the share of the value in parts (runs of letters) that are words of the corpus."""
    values = cands.select("value").distinct()
    parts = values.select("value", F.explode(F.filter(F.split(F.lower("value"), "[^\\p{L}]+"), lambda x: F.length(x) >= 3)).alias("word"))
    parts = work.store(parts, "parts")
    known = counted.where(F.col("n") >= WORD_ROWS).join(parts.select("word").distinct(), "word").select("word")
    cover = parts.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    share = F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))
    return cands.join(cover, "value", "left").withColumn("f_parts", share).drop("covered")


def _shape(words: list[str]) -> dict[str, Column]:
    value, n = F.col("value"), F.length("value").cast("double")
    letters = "".join(_CLASSES.values())
    cls = F.translate(F.lower(value), letters, "".join(k * len(v) for k, v in _CLASSES.items()))
    out = {"f_length": n, "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / n}
    out["f_capitals"] = F.regexp_count(value, F.lit("[A-Z]")) / n
    out["f_case"] = F.regexp_count(value, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n
    for a in _CLASSES:
        out[f"f_{a}"] = F.regexp_count(cls, F.lit(a)) / n
        for b in _CLASSES:
            out[f"f_{a}{b}"] = F.regexp_count(cls, F.lit(f"{a}(?={b})")) / n
    known = "|".join(sorted(words, key=lambda x: (-len(x), x))) or "(?!)"
    for c in ("left1", "right1"):  # signs that neighbours end and begin with
        out[f"f_{c}_sign"] = F.coalesce(F.col(c).rlike("[=:]\\W*$" if c == "left1" else "^\\W"), F.lit(False)).cast("double")
    out["f_covered"] = F.lit(1.0) - F.length(F.regexp_replace(F.lower(value), f"(?:{known})", "")) / n
    return out


#: Context columns with log odds of their own: the last run of letters in each, ``name`` being that of both words to the left.
_CONTEXT = ("path", "left1", "right1", "name")


def _clean(c: str) -> Column:
    if c == "path":
        return F.coalesce(F.lower(c), F.lit(""))
    text = F.lower(F.concat_ws(" ", "left2", "left1") if c == "name" else F.coalesce(F.col(c), F.lit("")))
    letters = F.regexp_extract(text, "(\\p{L}+)[^\\p{L}]*$", 1)
    return F.when(letters != "", letters).otherwise(text)


def _counts(train: DataFrame) -> DataFrame:
    """c, k, and for each half of the (bounded) training rows p, the positive ones, and n, all that have the value k in the context column c."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _clean(c).alias("k")) for c in _CONTEXT]))
    rows = train.select("half", "label", each.alias("e"))
    halves = [(f"{name}{h}", F.sum(F.when(F.col("half") == h, x).otherwise(0))) for h in (0, 1) for name, x in (("p", F.col("label")), ("n", F.lit(1)))]
    return rows.groupBy("e.c", "e.k").agg(*[x.alias(name) for name, x in halves])


def _with_context(rows: DataFrame, counts: DataFrame, training: bool) -> DataFrame:
    """Smoothed log odds of label 1 for each context column; a training row takes those of the half it isn't in."""
    p, n = (F.when(F.col("half") == 0, F.col(f"{x}1")).otherwise(F.col(f"{x}0")) if training else F.col(f"{x}0") + F.col(f"{x}1") for x in "pn")
    for c in _CONTEXT:
        table = F.broadcast(counts.where(F.col("c") == c))  # at most 2 * MAX_ROWS rows
        rows = rows.join(table, _clean(c) == F.col("k"), "left").withColumn(f"f_{c}", F.coalesce(F.log((p + 0.5) / (n - p + 0.5)), F.lit(0.0)))
        rows = rows.drop(*counts.columns)
    return rows


def judge(cands: DataFrame, findings: DataFrame, counted: DataFrame, work: Work, rule: Column | None = None) -> DataFrame:
    """Candidates with ``probability`` and ``is_secret``; ``findings`` are labelled candidates, ``counted`` is the vocabulary;
    ``rule`` stands in if no forest can be fitted."""
    words = dictionary(counted)
    given = ["value", "path", "left2", "left1", "right1", "f_parts"]
    findings, cands = (x if "f_parts" in x.columns else with_known_parts(x, counted, work) for x in (findings, cands))
    known = findings.where(F.col("label").isin(0, 1)).select(*given, F.col("label").cast("long").alias("label")).distinct()
    by_hash = F.xxhash64("value", "left2", "left1", "right1", "path")
    sample = [known.where(F.col("label") == y).orderBy(by_hash, "value").limit(MAX_ROWS) for y in (0, 1)]
    train = work.store(sample[0].union(sample[1]).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2))).coalesce(1), "findings")
    per = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ["doc_id", "word_index", "run", "value", "left2", "left1", "right1", "path"]
    if len(per) < 2:
        p = F.lit(1.0 if per.get(1) else 0.0) if rule is None else F.coalesce(rule.cast("double"), F.lit(0.0))
        return cands.select(*out, p.alias("probability"), (p >= THRESHOLD).alias("is_secret"))
    shape = _shape(words)
    names = [*shape, "f_parts", *(f"f_{c}" for c in _CONTEXT)]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    counts = work.store(_counts(train), "odds")
    known = work.store(_with_context(train.withColumns(shape), counts, True).coalesce(1), "learnt")
    # a third is also learnt from without its neighbours, as candidates among words never seen are judged
    hidden = known.where(F.pmod(F.xxhash64(F.lit("hidden"), "value"), F.lit(3)) == 0).withColumns({f"f_{c}": F.lit(0.0) for c in _CONTEXT})
    known = known.unionByName(hidden)
    ready = assemble.transform(known).select("features", F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(ready.coalesce(1))
    scored = model.transform(assemble.transform(_with_context(cands.withColumns(shape), counts, False)))
    scored = scored.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*out, "probability", (F.col("probability") >= THRESHOLD).alias("is_secret"))


def scan(docs: DataFrame, work: Work, findings: DataFrame | None = None) -> DataFrame:
    """Judged candidates of all documents; without labelled findings, those labelled by rule are learnt from."""
    counted = work.store(vocabulary(docs), "vocabulary")
    found = work.store(candidates(docs), "candidates")
    found = work.store(with_known_parts(found, counted, work), "known")
    if findings is None:
        words = dictionary(counted)
        return judge(found, labelled_by_rule(found, words), counted, work, rule_label(words))
    return judge(found, findings, counted, work)


def _masked(text: Column, value: Column) -> Column:
    """A long value goes wherever it stands, a short one as a whole where it is assigned or stands in a line of a key."""
    quoted = F.concat(F.lit("(?<=[=:>][\\s\"'`]{0,6}|[\\s`'\"]KEY-----[\\s]{0,3}|[\\n])\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9_])"))
    return F.when(F.length(value) >= 16, F.replace(text, value, F.lit(MASK))).otherwise(F.regexp_replace(text, quoted, F.lit(MASK)))


def mask(docs: DataFrame, work: Work) -> DataFrame:
    """The documents with every secret replaced by a mark; ``n_chars`` follows the text."""
    secret = scan(docs, work).where("is_secret").groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_set("value").alias("found"))  # of one document
    longest = F.array_sort("found", lambda a, b: F.length(b) - F.length(a))
    j = docs.join(secret.withColumn("found", longest), docs.doc_id.eqNullSafe(F.col("s_id")), "left")
    masked = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.aggregate("found", F.col("text"), _masked))
    return j.withColumn("text", masked).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)

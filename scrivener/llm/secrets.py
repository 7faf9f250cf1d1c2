"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

MASK = "<SECRET>"
#: Bounds: labelled findings in the fitting sample; words of the dictionary learned from the texts, and how often each must occur.
MAX_FINDINGS = 20_000
#: Generated examples of either label, and the weight that those of a label have together: as much as so many findings.
PRIOR_ROWS, PRIOR_WEIGHT = 240, 12.0
DICTIONARY_WORDS, DICTIONARY_LEAST = 20_000, 5
#: A value with so many different surroundings, half of its places at least, is no secret but something that is
#: written in many texts. (Near copies of one text share most of their surroundings.)
CONTEXTS = 3
#: Names under which secrets are given, values that stand for one, parts of paths that hold examples, and the forms of some issuers' keys.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth", "authorization", "credential", "credentials", "bearer", "key")
#: Names that stand for a secret inside other words too; words between a name and its value; the last words before a private key.
PLAIN_NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "access_key", "secret_key", "authorization", "credential", "credentials")
SCHEMES, PEM_WORDS = r"(?i)^(?:bearer|basic|token)$", ("PRIVATE", "KEY-----")
PLACEHOLDERS = r"(?i)^\W*(?:your[\w\-]*|change[\w\-]*|example[\w\-]*|placeholder|password|secret|token|none|null|true|false|x+|\*+|<.*>|\$\{.*\})\W*$"
EXAMPLE_PATHS = r"(?i)test|example|sample|fixture|demo|doc|mock"
ISSUED = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_\-]{35})$"
#: Values of forms that name things openly: identifiers with a version, times.
OPEN = r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[089abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.+Z\-]*)$"
_BODY = r"[A-Za-z0-9+/_=\-]"
#: A run of 16 or more key characters with a digit, looked at from its start only (so in linear time), or whatever is assigned to a secret's name within one word.
LONG = rf"(?<!{_BODY})(?=[A-Za-z+/_=\-]*[0-9]){_BODY}{{16,}}"
#: A name of a secret; the first letter is looked at before the names are tried, as most places have another.
_NAMED = "(?i)(?=[" + "".join(sorted({n[0] for n in NAMES})) + "])(?:" + "|".join(PLAIN_NAMES) + "|(?<![a-z0-9])(?:" + "|".join(n for n in NAMES if n not in PLAIN_NAMES) + "))"
_ASSIGN = _NAMED + r"[\"'`\])]*(?:=>|:=|[=:])[\"'`]?"
ASSIGNED = _ASSIGN + r"""([^\s"'`<>]{6,})"""
#: What some part of a text must match for it to hold a candidate.
LOOSE = _NAMED + r"\W*[=:]|PRIVATE KEY-----|" + LONG
_NAME = r"(?i)^\W*(?:[a-z]+[_\-])*(?:" + "|".join(NAMES) + r")\W*$"
#: A word that ends in a name and its sign (``password:``, ``{"a":1,"token":``), and one that begins with a sign.
_NAME_SIGN = r"(?i)(?<![a-z0-9])(?:" + "|".join(NAMES) + r")[\"'`\])]*(?:=>|:=|[=:])$"
_SIGN_VALUE = r"^(?:=>|:=|[=:])"
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "switches", "distinct", "entropy", "hexadecimal", "dictionary", "quoted", "example_path", "before_length", "after_length", "before_signs", "before_known", "after_known")


def named(before2: Column, before: Column, word: Column) -> Column:
    """True for a word that the two before it say is a secret: a name and a sign, a name and a scheme, or the head of a private key."""
    sign_before = before.isin("=", ":", "=>", ":=") & before2.rlike(_NAME)
    own_sign = word.rlike(_SIGN_VALUE) & before.rlike(_NAME)
    scheme = before.rlike(SCHEMES) & before2.rlike(_NAME_SIGN)
    return sign_before | before.rlike(_NAME_SIGN) | own_sign | scheme | ((before2 == PEM_WORDS[0]) & (before == PEM_WORDS[1]))


def _value(word: Column) -> Column:
    """A word without the marks that surround a value: signs before it, quotes and brackets around it, stops behind it."""
    return F.btrim(F.rtrim(F.regexp_replace(word, r"^(?:=>|:=|[=:])", ""), F.lit(".,;:\"'`)]}>")), F.lit("\"'`([{<"))


def findings(docs: DataFrame, *, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidate rows: ``keep`` columns, ``finding`` (a long: place of the word times 2**32, and place in it), ``value``, ``before2``, ``before``, ``word``, ``after``, ``path``.

    A candidate is a run of 16 or more key characters holding a digit, a word whose value
    has six or more characters, a letter or digit among them, right after a name and a sign (``password = p@ss-w0rd!``, the sign being
    a word of its own or part of either neighbour, as in ``"password": "hunter2"``), after a name and a scheme
    (``Authorization: Bearer ...``) or the head of a private key, or what one word assigns.
    A word gives all its candidates: values assigned, long runs in
    them and beside them, and its value after a name. Texts are whole; those in which no pattern occurs are dropped by one
    regular expression before they are split. Null and empty texts have none.
    """
    words = F.split(F.col(text), r"[\x20\x09-\x0D]+")
    some = docs.where(F.col(text).rlike(LOOSE)).select(*keep, F.col(path).cast("string").alias("path"), words.alias("_words"))

    def word(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_words"), i), F.lit(""))

    def after_name(i: Column) -> Column:
        return named(word(i - 2), word(i - 1), word(i)) & (F.length(_value(word(i))) >= 6) & _value(word(i)).rlike("[A-Za-z0-9]")

    spots = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("word"), after_name(i).alias("named"))), lambda x: x["word"].rlike(LONG) | x["word"].rlike(ASSIGNED) | x["named"])
    at = some.select(*keep, "path", "_words", F.explode(spots).alias("_x"))
    i = F.col("_x.i")
    at = at.select(*keep, "path", i.alias("_i"), F.col("_x.word").alias("word"), F.col("_x.named").alias("_named"), word(i - 2).alias("before2"), word(i - 1).alias("before"), word(i + 1).alias("after"))
    runs = lambda x: F.regexp_extract_all(x, F.lit(rf"({LONG})"), F.lit(1))
    given = F.filter(F.transform(F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(1)), lambda x: F.rtrim(x, F.lit(".,;:)]}"))), lambda x: F.length(x) >= 6)
    inside, beside = F.flatten(F.transform(given, runs)), runs(F.regexp_replace("word", ASSIGNED, " "))
    quoted = F.regexp_extract("word", r"""^[^\w"'`]*["'`]([^"'`]{6,})["'`]""", 1)
    told = F.when(F.col("_named"), F.array(F.when(quoted != "", quoted).otherwise(_value(F.col("word"))))).otherwise(F.array().cast("array<string>"))
    # a word that assigns is not a value as a whole
    values = F.array_distinct(F.concat(F.when((F.size(given) > 0) & (quoted == ""), F.array().cast("array<string>")).otherwise(told), given, inside, beside))
    return at.select(*keep, "path", "word", "before2", "before", "after", "_i", F.posexplode(values).alias("_j", "value")).select(
        *keep, (F.shiftleft(F.col("_i").cast("long"), 32) + F.col("_j")).alias("finding"), "value", "before2", "before", "word", "after", "path"
    )


#: The features of its surroundings that a finding has in the middle of prose.
IN_PROSE = {"quoted": 0.0, "before_length": 5.0, "after_length": 5.0, "before_signs": 0.0, "before_known": 1.0, "after_known": 1.0}


def known_words(docs: DataFrame, *, text: str = "text", most: int = DICTIONARY_WORDS, least: int = DICTIONARY_LEAST) -> DataFrame:
    """Rows ``known``: the words of three or more letters that occur most in the texts, each at least ``least`` times.

    Words are counted over all texts as they stand, combined before the shuffle; only
    distinct ones are stripped of marks. ``most`` bounds the table, so it may be broadcast.
    """
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(text), r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").count()
    plain = words.select(F.regexp_extract("w", r"^[^\p{L}\p{N}]*(\p{L}{3,})[^\p{L}\p{N}]*$", 1).alias("known"), "count").where("known <> ''")
    return plain.groupBy("known").agg(F.sum("count").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "known").limit(most).select("known")


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the doubles of ``FEATURES``: length, character make-up and transitions, dictionary coverage, path and neighbouring words.

    ``known`` is the dictionary (:func:`known_words`), bounded by parameter. None of the
    evidence that labels findings (:func:`sure_labels`) is a feature.
    """
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern, c=v: F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))
    chars = F.split(v, "")
    times = lambda c: n - F.length(F.replace(v, c, F.lit("")))
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - times(c) / n * F.log2(times(c) / n))
    bare = lambda c: F.regexp_extract(F.lower(c), r"(\p{L}{3,})", 1)
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("known"))
    covered = runs.join(F.broadcast(known), "known").groupBy("value").agg(F.sum(F.length("known")).alias("_covered"))
    out = found.join(covered, "value", "left")
    for side in ("before", "after"):
        words = F.broadcast(known.select(F.col("known").alias(f"_{side}")))
        out = out.join(words, bare(F.col(side)) == F.col(f"_{side}"), "left")
    columns = {
        "length": F.length(v).cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
        "switches": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"), "distinct": F.size(F.array_distinct(chars)) / n, "entropy": entropy,
        "hexadecimal": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"), "dictionary": F.coalesce("_covered", F.lit(0)) / n, "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "example_path": F.coalesce(F.col("path").rlike(EXAMPLE_PATHS), F.lit(False)).cast("double"), "before_length": F.length("before").cast("double"), "after_length": F.length("after").cast("double"),
        "before_signs": share("[^\\p{L}\\p{N}]", F.col("before")), "before_known": F.col("_before").isNotNull().cast("double"), "after_known": F.col("_after").isNotNull().cast("double"),
    }
    return out.withColumns(columns).drop("_covered", "_before", "_after")


def sure_labels(found: DataFrame) -> DataFrame:
    """``found`` rows with ``label`` 1 or 0 where there is evidence, null elsewhere.

    0: the value passes the check digit of card numbers, has an open form, stands for a
    secret to be filled in, or has ``CONTEXTS`` or more different surroundings. Else 1: it
    has the form of an issuer's keys, or is given under a secret's name. Where reviewed
    findings exist, use those instead: rows with the columns of :func:`findings` and ``label``.
    """
    contexts = found.groupBy("value").agg(F.count_distinct("before2", "before", "after").alias("_contexts"), F.count("*").alias("_places"))
    inside = F.concat(F.lit(_ASSIGN + "\\Q"), F.replace("value", F.lit("\\E"), F.lit("")), F.lit("\\E"))
    given = named(F.col("before2"), F.col("before"), F.col("word")) | F.rlike("word", inside)
    luhn = F.col("value").rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", F.col("value"))
    shown = luhn | F.col("value").rlike(OPEN) | F.col("value").rlike(PLACEHOLDERS) | ((F.col("_contexts") >= CONTEXTS) & (2 * F.col("_contexts") >= F.col("_places")))
    return found.join(contexts, "value").withColumn("label", F.when(shown, 0.0).when(given | F.col("value").rlike(ISSUED), 1.0)).drop("_contexts", "_places")


def held_out_value() -> Column:
    """A fifth of the values, by hash: never learned from, so that the forest can be measured on them."""
    return F.pmod(F.xxhash64(F.lit(11), "value"), F.lit(5)) == 0


def prior_findings(known: DataFrame) -> DataFrame:
    """Generated findings with ``label``, so that a forest can be fitted to any corpus: ``PRIOR_ROWS`` of either label, from hashes of their numbers.

    1: keys of letters and digits, in capitals, hexadecimal or base 64, and passwords with signs. 0: plain numbers,
    dates and times, paths, serial numbers in groups, and identifiers made of the dictionary's own words and of such
    words read backwards, as it knows not every word. They stand in prose, between words of the dictionary.
    """
    spark = known.sparkSession
    n = spark.range(2 * PRIOR_ROWS).select(F.col("id"), (F.col("id") % 2).cast("double").alias("label"), F.floor(F.col("id") / 2).alias("k"))
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("k").cast("string")), 512)
    number = lambda salt, most: F.pmod(F.xxhash64(F.lit(salt), "k"), F.lit(most))
    code = F.regexp_replace(F.base64(F.unhex(h("code"))), "[+/=]", "")
    size = (F.lit(16) + number(1, 29)).cast("int")
    # words by their place in the dictionary's order; it is bounded by parameter
    listed = known.agg(F.sort_array(F.collect_list("known")).alias("_known"))
    spoken = lambda salt: F.coalesce(F.try_element_at("_known", (number(salt, 1 << 40) % F.greatest(F.size("_known"), F.lit(1)) + 1).cast("int")), F.lit("word"))
    secret = F.when(F.col("k") % 5 == 0, F.substring(h("hex"), 1, 32)).when(F.col("k") % 5 == 1, F.substr(F.upper(code), F.lit(1), size)).when(F.col("k") % 5 == 2, F.substring(F.base64(F.unhex(h("raw"))), 1, 40))
    secret = secret.when(F.col("k") % 5 == 3, F.concat(F.substring(code, 1, 4), F.element_at(F.array(*[F.lit(x) for x in "!@$%&#"]), (number(2, 6) + 1).cast("int")), F.substring(code, 9, 5))).otherwise(F.substr(code, F.lit(1), size))
    plain = F.when(F.col("k") % 5 == 0, F.substr(F.concat(number(3, 10**15).cast("string"), number(4, 10**15).cast("string")), F.lit(1), F.least(size, F.lit(20))))
    plain = plain.when(F.col("k") % 5 == 1, F.date_format(F.timestamp_seconds(number(5, 2 * 10**9)), "yyyy-MM-dd-HH-mm-ss")).when(F.col("k") % 5 == 2, F.concat_ws("/", spoken("a"), spoken("b"), F.concat(F.lit("part-"), F.lpad(number(6, 10**4).cast("string"), 5, "0"))))
    strange = lambda salt: F.when(F.col("k") % 2 == 0, F.reverse(spoken(salt))).otherwise(spoken(salt))
    plain = plain.when(F.col("k") % 5 == 3, F.concat_ws("_", strange("c"), F.when(F.col("k") % 3 == 0, (2000 + number(13, 30)).cast("string")), strange("d"), strange("e"), F.when(F.col("k") % 4 < 2, strange("i")), number(7, 3000).cast("string"))).otherwise(F.concat_ws("-", *[F.when(number(20 + s, 3) == 0, F.translate(F.substring(h(str(s)), 1, 4), "0123456789", "ghijklmnop")).otherwise(number(s, 10**4).cast("string")) for s in range(8, 13)]))
    rows = n.crossJoin(F.broadcast(listed))  # one row: the dictionary
    return rows.select(F.when(F.col("label") == 1, secret).otherwise(plain).alias("value"), "label", spoken("f").alias("before2"), spoken("g").alias("before"), spoken("h").alias("after"), F.lit(None).cast("string").alias("path")).withColumn("word", F.col("value"))


def fit(labelled: DataFrame, prior: DataFrame, *, trees: int = 20, depth: int = 6, seed: int = 3, max_findings: int = MAX_FINDINGS) -> Model:
    """Random forest over ``FEATURES`` from findings with ``label`` 0 or 1, but for the held-out fifth, and the ``prior`` ones.

    Each value counts once for a label. Of each label at most about ``max_findings`` / 2 are used, chosen by a hash of the
    value (all where there are fewer). Each is learned from as it stands and as if it
    stood in prose, since evidence such as a name comes with surroundings of its own, by
    which alone the forest must not go. The prior findings of a label weigh as much as ``PRIOR_WEIGHT`` others, and both
    labels weigh the same in all, so a corpus with few findings, or with one label only, is
    judged by a forest as any other is. Spark fits the forest over its partitions.
    """
    usable = labelled.where(F.col("label").isNotNull() & ~held_out_value())
    # a value counts once for its label, however many copies of its text there are
    usable = usable.groupBy("value", "label").agg(F.min(F.struct(*FEATURES)).alias("f")).select("value", "label", "f.*")
    found = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = {y: min(1.0, max_findings / 2 / max(found.get(y, 0), 1)) for y in (0.0, 1.0)}
    sample = usable.where(F.pmod(F.xxhash64(F.lit(seed), "value"), F.lit(1_000_000)) < F.when(F.col("label") == 1.0, share[1.0]).otherwise(share[0.0]) * 1_000_000)
    own = sample.select("label", *FEATURES).withColumn("weight", F.lit(1.0))
    bare = own.select("label", *[F.lit(IN_PROSE[f]).alias(f) if f in IN_PROSE else F.col(f) for f in FEATURES], "weight")
    rows = staged(own.union(bare).union(prior.select("label", *FEATURES, F.lit(2 * PRIOR_WEIGHT / PRIOR_ROWS).alias("weight"))), "labelled")
    totals = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    even = F.col("weight") * F.when(F.col("label") == 1.0, sum(totals.values()) / totals[1.0]).otherwise(sum(totals.values()) / totals[0.0])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("weight", even)).select("label", "features", "weight")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", weightCol="weight").fit(ready)


def confirm(found: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """``found`` (with features) with the forest's ``probability`` and ``confirmed``."""
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = model.transform(ready).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")
    return scored.withColumn("confirmed", F.col("probability") >= threshold)


def judged(docs: DataFrame, *, text: str, path: str, keep: tuple[str, ...], every: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings of ``docs`` with features, label, probability and verdict; the dictionary comes from all texts of ``every``."""
    found = staged(findings(docs, text=text, path=path, keep=keep), "findings")
    known = staged(known_words(every, text=text), "words")
    featured = staged(sure_labels(with_features(found, known)), "features")
    model = fit(featured if labelled is None else with_features(labelled, known), with_features(prior_findings(known), known))
    return confirm(featured, model, threshold=threshold)


def scan(docs: DataFrame, *, text: str = "text", path: str = "source", key: str = "doc_id", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a candidate: ``key, finding, value, path, probability, confirmed``.

    ``labelled`` are reviewed findings (columns of :func:`findings` and ``label``); without
    them the forest learns from findings with evidence (:func:`sure_labels`) and judges all
    by their features. Repeated rows give repeated findings; an empty table gives none.
    """
    found = judged(docs, text=text, path=path, keep=(key,), every=docs, labelled=labelled, threshold=threshold)
    return found.select(key, "finding", "value", "path", "probability", "confirmed")


def redact(docs: DataFrame, *, text: str = "text", path: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs``, all rows, with every confirmed secret in ``text`` replaced by ``MASK``.

    Rows that hold a candidate (few) are set aside with a row number, scanned, and joined
    with their own secrets by that number; all others pass through unshuffled. Columns of
    any name stay as they are; the longest secrets are replaced first.
    """
    row, secrets = unused(docs, "_row", "_secrets")
    held = F.coalesce(F.col(text).rlike(LOOSE), F.lit(False))
    some = staged(docs.where(held).withColumn(row, F.monotonically_increasing_id()), "suspects")
    found = judged(some, text=text, path=path, keep=(row,), every=docs, labelled=labelled, threshold=threshold)
    sure = found.where("confirmed and value <> ''")
    lists = sure.groupBy(row).agg(F.collect_set(F.struct((-F.length("value")).alias("n"), F.col("value").alias("v"))).alias(secrets))
    clean = F.aggregate(F.sort_array(secrets), F.col(text), lambda t, s: F.replace(t, s["v"], F.lit(MASK)))
    changed = some.join(lists, row, "left").withColumn(text, F.when(F.col(secrets).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
    return docs.where(~held).unionByName(changed)

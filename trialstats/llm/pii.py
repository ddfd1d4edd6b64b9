"""Personal data: exact base spans, and information-theoretic sanitisation of the terms around them.

DataFrame operations only.  Base spans (email, ip, card, phone) come from
regular expressions over each whole text, leftmost and non-overlapping for each
kind; positions follow from the lengths of matches and of what lies between.

Around every base span up to SIDE whole words on each side, within REACH
characters, are its context.  Over the whole corpus, documents with a term, with
an entity (kind and lower-case value) and with the term in the entity's context
are counted.  How much of an entity's information a term discloses is the
pointwise mutual information over the entity's own information,

    disclosure = 1 - log p(entity | term) / log p(entity),

0 for an independent term and 1 for one that occurs with this entity alone.  A
term seen with an entity in at least `support` different texts is generalised
from `generalise` on and removed from `remove` on, where it stands in that
entity's context.  With `whole` the context of an entity is each whole text that
holds it, and a term is marked wherever it stands in such a text; the terms near
a span that no blank divides from it count too.  Only terms with a letter and without digit or "@" count, so
term spans never overlap base spans.

Defined cases: null and empty texts have no spans; repeated rows give a row
each with the same spans; an entity in every document has no information and
nothing discloses it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialstats.llm.store import stored

KINDS = ("email", "ip", "card", "phone", "term")
# possessive, and tried only where a longest run begins or the last match ended: same matches, linear time
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?+[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
WORD = r"[^ \t\n\x0B\f\r]+"
SIDE = 5
REACH = 120
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CONTEXT = "array<struct<entity:bigint,term:string,start:int,end:int>>"


def _sums(lengths: Column) -> Column:
    """Running sums of an array, by doubling: each round adds what stands 1, 2, 4, ... places before."""
    places = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(lengths)))), lambda k: F.pow(F.lit(2), k).cast("int"))
    step = lambda sums, by: F.transform(sums, lambda x, i: x + F.when(i >= by, F.get(sums, i - by)).otherwise(0))
    return F.aggregate(places, lengths, step)


def _with(value: Column, body) -> Column:
    """The array that `body` makes of `value`, which is evaluated once."""
    return F.flatten(F.transform(F.array(value), body))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of all matches."""
    between = F.split(text, pattern)

    def placed(values: Column) -> Column:
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(values)), values, lambda b, v: F.length(b) + F.length(v))
        return _with(_sums(lengths), lambda ends: F.zip_with(values, ends, lambda v, end: F.struct(
            (end - F.length(v)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), v.alias("value"),
        )))

    return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & F.coalesce(part(p).try_cast("int") <= 255, F.lit(True)))
    size = F.length(_digits(value))
    if kind == 2:
        return F.when((size >= 14) & (size <= 19), _luhn(_digits(value))).otherwise(False)
    return (size >= 10) & (size <= 15)


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind."""
    hint = ("@", "[0-9]\\.[0-9]", "[0-9][ -]?[0-9]", "\\+[0-9]")
    none = F.array().cast(SPAN)
    good = lambda k: F.filter(matches(text, PATTERNS[k], k), lambda s: _valid(k, s["value"]))
    each = [F.when(text.rlike(hint[k]), good(k)).otherwise(none) for k in range(4)]
    return F.array_sort(F.concat(*each))


def _words(slice_: Column, at: Column) -> Column:
    return F.transform(matches(slice_, WORD, 4), lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), F.lower(s["value"]).alias("term")))


def contexts(text: Column, spans: Column) -> Column:
    """Array of (entity, term, start, end): the words near each span."""

    def near(s: Column) -> Column:
        entity = F.xxhash64(s["kind"], F.lower(s["value"]))
        low = F.greatest(s["start"] - REACH, F.lit(0))
        left = _words(F.substring(text, low + 1, s["start"] - low), low)
        right = _words(F.substring(text, s["end"] + 1, F.lit(REACH)), s["end"])
        # a word cut by the reach is not whole
        left = F.when(low > 0, F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
        right = F.when(s["end"] + REACH < F.length(text), F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
        left = F.slice(left, F.greatest(F.size(left) - SIDE + 1, F.lit(1)), F.lit(SIDE))
        both = F.filter(F.concat(left, F.slice(right, F.lit(1), F.lit(SIDE))), lambda w: w["term"].rlike(r"\p{L}") & ~w["term"].rlike("[0-9@]"))
        return F.transform(both, lambda w: F.struct(entity.alias("entity"), w["term"].alias("term"), w["start"].alias("start"), w["end"].alias("end")))

    return F.flatten(F.transform(spans, near))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def entity_of(s: Column) -> Column:
    return F.xxhash64(s["kind"], F.lower(s["value"]))


def is_term(x: Column) -> Column:
    return x.rlike(r"\p{L}") & ~x.rlike("[0-9@]")


def whole_pairs(found: DataFrame, support: int) -> DataFrame:
    """(row, t, entity, term) once each, for the terms of whole texts and entities in at least `support` different ones."""
    held = found.where(F.size("base") > 0).select("row", "t", F.explode("base").alias("s")).select("row", "t", entity_of(F.col("s")).alias("entity")).distinct()
    often = held.groupBy("entity").agg(F.countDistinct("t").alias("texts")).where(F.col("texts") >= support).select("entity")
    entities = held.join(often, "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    rows = found.where(F.size("base") > 0).select("row", "t", "words", "context").dropDuplicates(["row"])
    one = rows.join(entities, "row").select("row", "t", "words", "context", F.explode("entities").alias("entity"))
    beside = F.transform(F.filter("context", lambda c: c["entity"] == F.col("entity")), lambda c: c["term"])
    return one.select("row", "t", "entity", F.explode(F.array_union("words", beside)).alias("term"))


def whole_places(found: DataFrame, plain: DataFrame, strong: DataFrame) -> DataFrame:
    """(row, start, end, term, disclosure) wherever a disclosing term is a word of a text that holds its entity."""
    held = found.where(F.size("base") > 0).select("row", F.explode("base").alias("s")).select("row", entity_of(F.col("s")).alias("entity")).distinct()
    words = found.where(F.size("base") > 0).dropDuplicates(["row"]).select("row", "words")
    many = held.join(strong, "entity").groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    here = many.join(words, "row").where(F.array_contains("words", F.col("term"))).select("row", "term", "disclosure")
    texts = plain.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(here.select("row").distinct(), "row").dropDuplicates(["row"])
    # blanks are single characters here, so that the lengths before a word give its place
    each = texts.select("row", F.posexplode(F.split("text", r"[ \t\n\x0B\f\r]")).alias("k", "word"))
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", (F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).cast("int"))
    placed = placed.select("row", "start", (F.col("start") + F.length("word")).alias("end"), F.lower("word").alias("term"))
    return placed.join(here, ["row", "term"]).select("row", "start", "end", "term", "disclosure")


def disclosing(found: DataFrame, docs: DataFrame, support: int, generalise: float, whole: bool = False) -> DataFrame:
    """(entity, term, disclosure) from all documents, for what reaches `generalise`."""
    if whole:
        by_text = whole_pairs(found, support).groupBy("entity", "term", "t").agg(F.count("*").alias("n"))
        together = by_text.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    else:
        pairs = found.select("row", "t", F.explode("context").alias("c")).select("row", "t", "c.entity", "c.term").distinct()
        together = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.countDistinct("t").alias("texts")).where(F.col("texts") >= support)
    entities = (
        found.select("row", F.explode("base").alias("s")).select("row", F.xxhash64("s.kind", F.lower("s.value")).alias("entity"))
        .distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    )
    # counted by hash in the map tasks first, so the shuffle carries each task's vocabulary and not its words
    terms = (
        docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"))).alias("term"))
        .groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("with_term"))
    )
    total = docs.count()
    known = together.withColumn("h", F.xxhash64("term")).join(terms, "h").join(entities, "entity")
    given = F.least(F.col("both") / F.col("with_term"), F.lit(1.0))
    prior = F.col("with_entity") / F.lit(float(max(total, 1)))
    measure = F.when(prior < 1, 1 - F.log(given) / F.log(prior)).otherwise(F.lit(0.0))
    return known.select("entity", "term", measure.alias("disclosure")).where(F.col("disclosure") >= generalise)


def spans(docs: DataFrame, support: int = 3, generalise: float = 0.5, remove: float = 0.8, whole: bool = False) -> DataFrame:
    """doc_id, row, base, terms: the base spans of each document, and the term spans with what happens to them.

    `row` identifies equal (doc_id, text) pairs.  terms: array of (start, kind, end, value, removed)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = plain.withColumn("base", base_spans(F.col("text")))
    near = F.when(F.size("base") > 0, contexts(F.col("text"), F.col("base"))).otherwise(F.array().cast(CONTEXT))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), is_term))
    kept = [F.when(F.size("base") > 0, words).otherwise(F.array().cast("array<string>")).alias("words")] if whole else []
    found = stored(base.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("t"), "base", near.alias("context"), *kept), "pii")
    strong = disclosing(found, plain, support, generalise, whole)
    strong = stored(strong, "strong") if whole else strong
    near_rows = found.where(F.size("context") > 0).select("row", F.explode("context").alias("c")).select("row", "c.*").distinct()
    places = near_rows.join(strong, ["entity", "term"]).select("row", "start", "end", "term", "disclosure")
    places = places.unionByName(whole_places(found, plain, strong)) if whole else places
    terms = (
        places.groupBy("row", "start", "end", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", F.col("term").alias("value"), (F.col("disclosure") >= remove).alias("removed")))).alias("terms"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,removed:boolean>>")
    return found.select("doc_id", "row", "base").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def all_spans() -> Column:
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(F.concat("base", plain))


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with base spans replaced by [KIND], generalised terms by [TERM] and removed ones by nothing.

    Overlapping base spans are replaced as one, by the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    marks = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise("[TERM]").alias("put"))),
    ))
    done = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, m: F.when(m["start"] < acc["at"], F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["start"] - acc["at"]), m["put"]).alias("out"))
    )
    text = F.aggregate("marks", done, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = found.where((F.size("base") > 0) | (F.size("terms") > 0)).select("row", marks.alias("marks")).dropDuplicates(["row"])
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))).join(changed.withColumnRenamed("row", "__row"), "__row", "left")
    return keyed.withColumn("text", F.when(F.col("marks").isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns)


def report(docs: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each document: counts by kind, a digest of the base spans, and all spans."""
    found = spans(docs, whole=whole)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    removed = F.size(F.filter("terms", lambda s: s["removed"])).cast("long").alias("n_terms_removed")
    return found.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(described(F.col("base")), 256).alias("base_sha256"),
        described(all_spans()).alias("spans"), F.size("terms").cast("long").alias("n_terms"), removed,
    )

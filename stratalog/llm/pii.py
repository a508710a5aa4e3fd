r"""Personal data: patterns, and information-theoretic sanitisation, by DataFrame operations only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. The
protected entities of a mention are its value, its group (an address's domain, an IPv4
network of 24 bits, a card's or phone's first digits), its kind, and personal data as such.
One event space holds for all counts: the corpus's distinct texts, of which n(e) mention
entity e, n(t) hold the word t outside base spans, and n(e,t) hold both, anywhere in the
text. Entities of fewer than SUPPORT texts can't reach SUPPORT with any word, so their pairs
aren't made. With N texts, t discloses the share
PMI(e;t) / IC(e) of e's information, where IC(e) = log2(N / n(e)) and
PMI(e;t) = log2(n(e,t) N / (n(e) n(t))). A word gives e away if that share reaches DISCLOSURE,
SUPPORT texts or more hold both, and the corpus is large enough to tell: with
p = n(e,t) / n(t) and q = n(e) / N, n(t) KL(p || q) is at least the logarithm of the number of
pairs looked at, so that less than about one pair in all would pass by chance. Every
occurrence of such a word in a document that mentions e is a span of kind `term`.
Sanitising generalises a base span to its kind and removes a term.

The patterns run once over the corpus; documents without a mention are done then.
A text is matched in linear time: patterns start at a run's first character or where
the last match ended (\G), with possessive repeats. Positions are code points, ends
exclusive. Null text counts as empty. Null and repeated doc_ids stay as rows. An empty
table gives none. A column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {k: f"[{k.upper()}]" for k in KINDS[:-1]} | {"term": ""}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G(?=[A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G(?=[0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words of letters.
TERM = r"\p{L}{3,}+"
DISCLOSURE, SUPPORT = 0.8, 3
#: Rows of further copies that are broadcast to be left out of the counts, 8 bytes each; more of them are joined by shuffle.
COPIES = 1_000_000
#: Parts that an entity's documents are dealt to when they meet its terms, so that none is hot.
SALTS = 16
#: Matches summed up at once.
CHUNK = 256


def located(text: Column, pattern: Column, valid: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, value>> of the pattern's matches that are valid."""

    def place(found: Column, gaps: Column) -> Column:
        # lengths of each match and the gap before it, summed up chunk by chunk, so that many matches cost little
        sizes = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("gap"), m.alias("m")))

        def chunk(state: Column, first: Column) -> Column:
            start = F.struct(state["at"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))
            one = lambda s, x: F.struct((s["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out"))
            return let(F.aggregate(F.slice(sizes, first, CHUNK), start, one), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))

        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint,value:string>>>").alias("out"))
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(CHUNK)), lambda i: i <= F.size(found))
        return F.filter(F.flatten(F.aggregate(firsts, zero, chunk)["out"]), lambda x: valid(x["value"]))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, lambda x: place(x["found"], x["gaps"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    each = lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: x - F.when(x > 9, 9).otherwise(0))
    total = F.aggregate(F.transform(F.split(F.reverse(digits(value)), ""), each), F.lit(0), lambda a, x: a + x)
    return F.length(digits(value)).between(12, 19) & (total % 10 == 0)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.regexp_like(v, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")),
    "card": luhn,
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans_of(text: Column, pattern: Column, valid: Callable[[Column], Column], kind: int) -> Column:
    return F.transform(located(text, pattern, valid), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Sorted array<struct<start, kind (its place in KINDS), end, value>>."""
    parts = []
    for n, kind in enumerate(KINDS[:-1]):
        hint = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(HINTS[kind]))
        parts.append(F.when(hint, spans_of(text, F.lit(PATTERNS[kind]), VALID[kind], n)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def value_of(span: Column) -> Column:
    """A mention's value without what may differ in writing."""
    return F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(digits(span["value"]))


def group_of(span: Column) -> Column:
    """Domain, network of 24 bits, or the first digits: 6 of a card, all but 7 of a phone number."""
    v = value_of(span)
    shorter = F.when(span["kind"] == 2, F.substring(v, 1, 6)).otherwise(F.regexp_extract(v, "^(.*).{7}$", 1))
    return F.when(span["kind"] == 0, F.substring_index(v, "@", -1)).when(span["kind"] == 1, F.substring_index(v, ".", 3)).otherwise(shorter)


def narrow(span: Column) -> list[Column]:
    """The entities of a mention of its own: its value and its group."""
    kind = span["kind"].cast("string")
    return [F.concat(F.lit("v"), kind, F.lit(":"), value_of(span)), F.concat(F.lit("g"), kind, F.lit(":"), group_of(span))]


def wide(base: Column) -> Column:
    """The entities that a text's mentions share: its kinds, and personal data as such."""
    kinds = F.array_distinct(F.transform(base, lambda s: F.concat(F.lit("k"), s["kind"].cast("string"))))
    return F.when(F.size(base) > 0, F.concat(kinds, F.array(F.lit("a")))).otherwise(F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def gaps(text: Column, base: Column) -> Column:
    """The texts before, between and after base spans, one more than there are spans."""
    strings = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<string>>").alias("out"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1)), F.lit(CHUNK)), lambda i: i <= F.size(base))

    def chunk(state: Column, first: Column) -> Column:
        # the stretch of text of CHUNK spans is taken first, so that many spans don't each go through the whole text
        some = F.slice(base, first, CHUNK)
        upto = F.array_max(F.transform(some, lambda x: x["end"]))
        piece = F.substring(text, state["at"].cast("int") + 1, F.greatest(upto - state["at"], F.lit(0)).cast("int"))

        def within(own: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                gap = F.substring(own["piece"], (s["at"] - own["at"]).cast("int") + 1, F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(gap)).alias("out"))

            return F.aggregate(own["some"], F.struct(own["at"].alias("at"), strings.alias("out")), step)

        done = let(F.struct(some.alias("some"), piece.alias("piece"), state["at"].alias("at")), within)
        return let(done, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))

    return let(F.aggregate(starts, zero, chunk), lambda s: F.concat(F.flatten(s["out"]), F.array(F.substring(text, s["at"].cast("int") + 1, F.length(text)))))


def words_by_gap(text: Column, base: Column) -> Column:
    """Lower-cased words of each gap."""
    return F.transform(F.when(F.size(base) > 0, gaps(text, base)).otherwise(F.array(text)), lambda g: words_of(F.lower(g)))


def vocabulary(text: Column, base: Column) -> Column:
    """Distinct lower-cased words outside base spans."""
    return F.array_distinct(F.flatten(words_by_gap(text, base)))


def own_entities(base: Column) -> Column:
    """Distinct values and groups that a text mentions."""
    return F.array_distinct(F.flatten(F.transform(base, lambda s: F.array(*narrow(s)))))


def met_by(texts: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """(id, entity, column) of those of texts' (id, entity) that entities has; each entity's texts are dealt to SALTS parts."""
    asked = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = entities.select("entity", column).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return asked.join(salted, ["entity", "salt"]).select("id", "entity", column)


def firsts(rows: DataFrame) -> DataFrame:
    """One row of each text, of rows with id and hash."""
    copied = rows.groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    more = stored(rows.select("id", "hash").join(copied, "hash").where("id > least").select("id"), "pii-copies")
    return rows.join(F.broadcast(more) if more.count() <= COPIES else more, "id", "left_anti")


def disclosing(found: DataFrame) -> DataFrame:
    """(entity, terms): the words that give each entity away; found has id, hash, text and base, one row of each text."""
    texts = found.count()
    told = found.where(F.size("base") > 0)
    counts = lambda of: told.select(F.explode(of).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    shared, own = counts(wide(F.col("base"))), counts(own_entities(F.col("base")))
    mentioned = told.select("id", F.explode(own_entities(F.col("base"))).alias("entity"))
    listed = met_by(mentioned, own, "n_e").groupBy("id").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    words_in = told.select("id", wide(F.col("base")).alias("wide"), vocabulary(F.col("text"), F.col("base")).alias("words"))
    # one pair a row, so that a text of many entities and words needs no room for all of its pairs
    few = words_in.select(F.explode("wide").alias("entity"), "words").select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    each = words_in.drop("wide").join(listed, "id").select(F.explode("entities").alias("e"), "words").select("e.entity", "e.n_e", F.explode("words").alias("term"))
    many = each.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.max("n_e").alias("n_e"))
    # the few shared entities hold many pairs each: their counts, five rows at most, go to where the pairs lie
    pairs = few.join(F.broadcast(shared), "entity").select("entity", "term", "n_et", "n_e").unionByName(many.select("entity", "term", "n_et", "n_e"))
    pairs = stored(pairs.where(F.col("n_et") >= SUPPORT), "pii-pairs")
    words = found.select(F.explode(vocabulary(F.col("text"), F.col("base"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= SUPPORT)
    looked_at = max(pairs.count(), 1)
    joined = pairs.join(words, "term")
    p, q = F.col("n_et") / F.col("n_t"), F.col("n_e") / F.lit(float(max(texts, 1)))
    share = 1 - F.ln(p) / F.ln(q)  # PMI / IC
    certain = F.col("n_t") * (p * F.ln(p / q) + F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - q))).otherwise(0.0))
    passed = joined.where((q < 1) & (p > q)).where((share >= DISCLOSURE) & (certain >= F.ln(F.lit(float(looked_at)))))
    return stored(passed.groupBy("entity").agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-terms")


def find(docs: DataFrame) -> DataFrame:
    """docs with base and spans: sorted arrays of (start, kind, end, value)."""
    docs = docs.drop("base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*docs.columns)
    found = stored(docs.select(row.alias("row"), base_spans(text).alias("base"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("id")), "pii")
    of = F.coalesce(F.col("row.text"), F.lit(""))
    terms = disclosing(firsts(found.select("id", "hash", of.alias("text"), "base")))
    told = found.where(F.size("base") > 0)
    asked = told.select("id", F.explode(F.concat(wide(F.col("base")), own_entities(F.col("base")))).alias("entity"))
    given = met_by(asked, terms, "terms").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    met = told.join(given, "id", "left").withColumn("terms", F.array_intersect(F.coalesce("terms", F.array().cast("array<string>")), vocabulary(of, F.col("base"))))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    more = F.filter(spans_of(of, pattern, lambda v: F.lit(True), KINDS.index("term")), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.when(F.size("terms") > 0, F.array_sort(F.concat("base", more))).otherwise(F.col("base"))
    clean = found.where(F.size("base") == 0).select("row.*", "base", F.col("base").alias("spans"))
    return clean.unionByName(met.select("row.*", "base", spans.alias("spans")))


def listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """text with each span, or overlapping ones by the first's kind, generalised or removed."""
    tags = F.array(*(F.lit(TAGS[k]) for k in KINDS))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        upto = F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.get(tags, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(upto).alias("out"))

    done = let(F.aggregate(spans, zero, step), lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their texts sanitised; n_chars follows the text."""
    keep = docs.columns
    named = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("base", "spans") if c in keep})
    out = find(named).withColumn("text", sanitised(F.col("text"), F.col("spans")))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("base", "spans").withColumnsRenamed({f"__own_{c}": c for c in keep}).select(*keep)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    count = [number(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:-1])]
    return found.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

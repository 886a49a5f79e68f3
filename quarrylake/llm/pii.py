"""Operator 6, information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are found by patterns: e-mail and IP addresses, card and phone numbers. The protected entities are what they stand for, at
four levels, since most values occur once: any personal data, its kind, a group (mail domain, first half of an address, issuer of a
card, first digits of a number) and the value itself. Terms are the other words of a text; those with digits, which hardly ever
recur, count by their length and whether they have letters.

All counts are over the whole corpus, wherever in a text term t and entity e stand. Copies of a text with entities count once, as
they would make each of its rare words telling; other documents count each. P(e | t) is the lower bound, by
Wilson's interval, of n(t, e) / n(t); the term's disclosure is log(P(e | t) / P(e)) / log(1 / P(e)), the share of the entity's
information that it gives away: 1 if the term always means the entity, 0 if it says nothing. A pair counts if it can't be chance: the
Chernoff bound of n(t, e) or more texts by chance, times the number of pairs, stays below CHANCE, and it is seen in two texts at
least, as in a single text any word stands beside any other; and only if the entity is more likely there than not, P(e | t) >= CERTAIN,
as against a very rare entity almost any rare word gives much information, however seldom it is right. A term's disclosure is the
largest over entities. From GENERALISE on it is generalised and from REMOVE on removed, in every place of every document.

Patterns are written so that Java's matcher takes time in proportion to the text: no attempt starts inside a run that an earlier
attempt has gone through. They match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm._work import sent, shared_dir, stored

# Kinds in order, patterns, and a cheap test that every text with a match passes.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM_TAG = "[TERM]"
WORD = r"[\p{L}\p{N}]{2,}+"
PLAIN = r"(?<![\p{L}\p{N}])\p{L}{2,}+(?!\p{N})"
CODED = r"(?<![\p{L}\p{N}])(?:\p{L}++\p{N}|\p{N}[\p{L}\p{N}])[\p{L}\p{N}]*+"
GENERALISE = 0.6
REMOVE = 0.9
CERTAIN = 0.5
CHANCE = 0.05
Z = 1.96


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _running(steps: Column, whole, join) -> Column:
    """whole(first steps up to i) for each i, by blocks of the cube root of twice the number of steps, which keeps the work for n steps
    near n ** (4 / 3); join puts two results together."""

    def of_blocks(z: Column) -> Column:
        s, b = z["s"], z["b"]
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / b).cast("int")), lambda k: whole(F.slice(s, k * b + 1, b)))
        before = let(parts, lambda t: F.transform(t, lambda _, k: F.when(k > 0, whole(F.slice(t, F.lit(1), k))).otherwise(F.lit(0))))
        return let(before, lambda y: F.transform(s, lambda _, i: join(F.get(y, F.floor(i / b).cast("int")), whole(F.slice(s, F.floor(i / b).cast("int") * b + 1, i % b + 1)))))

    return let(F.struct(steps.alias("s"), F.ceil(F.cbrt(F.size(steps) * F.lit(2.0))).cast("int").alias("b")), of_blocks)


def running(steps: Column) -> Column:
    """Running sums of an int array with at least one step."""
    return _running(steps, _total, lambda x, y: x + y)


def running_max(steps: Column) -> Column:
    """Running maxima of an array of ints from 0 with at least one step."""
    return _running(steps, F.array_max, F.greatest)


CHUNK = 256


def chunks(text: Column) -> Column:
    """text in chunks of CHUNK code points: a place in a chunk is found in a short walk, one in a text by a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def between(parts: Column, a: Column, b: Column) -> Column:
    """Code points a .. b - 1 of a text in chunks; nothing if b <= a."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    near = F.substring(F.get(parts, first), a % CHUNK + 1, b - a)
    far = F.concat(
        F.coalesce(F.substring(F.get(parts, first), a % CHUNK + 1, F.lit(CHUNK)), F.lit("")),
        F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(parts, last), F.lit(1), b % CHUNK), F.lit("")),
    )
    return F.when(b <= a, F.lit("")).when(first == last, near).otherwise(far)


def matches(text: Column, pattern: str) -> Column:
    """array of struct(start, end, value) of all matches, in code points, end exclusive; for texts with at least one match."""

    def placed(z: Column) -> Column:
        steps = F.transform(z["m"], lambda _, i: F.length(F.get(z["p"], i)) + F.coalesce(F.length(F.get(z["m"], i - 1)), F.lit(0)))
        return let(running(steps), lambda at: F.transform(z["m"], lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"))))

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """array of struct(start, rank, end, value) by start, then kind; rank is the place in KINDS."""
    text = F.coalesce(text, F.lit(""))

    def kind(rank: int, gate: Column, pattern: str, valid=None) -> Column:
        found = F.transform(matches(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
        found = found if valid is None else F.filter(found, lambda x: valid(x["value"]))
        return F.when(gate & text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>"))

    all_ = F.concat(
        kind(0, F.contains(text, F.lit("@")), EMAIL),
        kind(1, F.contains(text, F.lit(".")), IP, lambda m: F.forall(F.split(m, r"\."), lambda p: p.try_cast("double") <= 255)),
        kind(2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))),
        kind(3, F.contains(text, F.lit("+")), PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
    )
    return F.array_sort(all_)


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def term_of(word: Column) -> Column:
    """What a word counts as: itself in lower case; with digits, its length and whether there are letters."""
    size = F.length(word).cast("string")
    return F.when(word.rlike(r"\p{N}"), F.concat(F.when(word.rlike(r"\p{L}"), F.lit("#a")).otherwise(F.lit("#9")), size)).otherwise(F.lower(word))


def replaced(text: Column, spans: Column, tag) -> Column:
    """text with its spans, structs with start and end in order of start, at least one, replaced by tag(span, first place not yet replaced).

    Of a span that overlaps one before only what is left is replaced, by tag as well. What stands between is cut out once.
    """

    def piece(z: Column, x: Column, at: Column) -> Column:
        return F.when(x["end"] <= at, F.lit("")).otherwise(F.concat(between(z["parts"], at, x["start"]), tag(x, F.greatest(x["start"], at))))

    def pieces(z: Column) -> Column:
        before = F.transform(z["s"], lambda x, i: piece(z, x, F.coalesce(F.get(z["ends"], i - 1), F.lit(0))))
        rest = between(z["parts"], F.element_at(z["ends"], -1), z["size"])
        return F.concat(F.array_join(before, ""), rest)

    ends = running_max(F.transform(spans, lambda x: x["end"]))
    return let(F.struct(spans.alias("s"), ends.alias("ends"), chunks(text).alias("parts"), F.length(text).alias("size")), pieces)


def masked(text: Column, spans: Column) -> Column:
    """text with spaces in place of its base spans: no word of them is left, and all others stand where they stood."""
    return F.when(F.size(spans) > 0, replaced(text, spans, lambda x, at: F.repeat(F.lit(" "), x["end"] - at))).otherwise(text)


def entities(spans: Column) -> Column:
    """The distinct entities of base spans: any, and kind, group and value of each."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def of(x: Column) -> Column:
        kind, digits = F.get(kinds, x["rank"]), _digits(x["value"])
        value = F.when(x["rank"] == 0, F.lower(x["value"])).when(x["rank"] == 1, x["value"]).otherwise(digits)
        group = F.when(x["rank"] == 0, F.substring_index(F.lower(x["value"]), "@", -1)).when(x["rank"] == 1, F.substring_index(x["value"], ".", 2)).when(x["rank"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
        return F.array(kind, F.concat(kind, F.lit(":"), group), F.concat(kind, F.lit("="), value))

    return F.array_distinct(F.concat(F.array(F.lit("any")), F.flatten(F.transform(spans, of))))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with spans, computed once for a row."""
    return docs.select("*", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(h, term): the distinct terms of each row's text; plain words need no look at each, as they are terms in lower case."""
    plain = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PLAIN), F.lit(0)))
    coded = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CODED), F.lit(0)), term_of))
    return docs.where("text is not null").select(F.xxhash64("text").alias("h"), F.explode(F.concat(plain, coded)).alias("term"))


def telling_terms(docs: DataFrame, least: float = GENERALISE, chance: float = CHANCE, certain: float = CERTAIN) -> DataFrame:
    """term, disclosure of the terms of docs(text) that disclose an entity by `least` or more, stored."""
    found = with_spans(docs.select("text")).where(F.size("spans") > 0)
    words = F.array_distinct(F.transform(F.regexp_extract_all(masked(F.col("text"), F.col("spans")), F.lit(WORD), F.lit(0)), term_of))
    found = found.select(F.xxhash64("text").alias("h"), entities(F.col("spans")).alias("e"), words.alias("terms"))
    found = stored(found.groupBy("h").agg(F.first("e").alias("e"), F.first("terms").alias("terms"), F.count("*").alias("c")), "pii-found")
    # Any and the kinds need no join; of groups and values only those that recur go on.
    each = found.select("terms", F.explode("e").alias("e")).select("terms", F.col("e").isin("any", *KINDS).alias("few"), F.xxhash64("e").alias("e"))
    n_e = stored(each.groupBy("e").agg(F.count("*").alias("n_e")).where("n_e > 1"), "pii-entities")
    each = each.where("few").unionByName(each.where("not few").join(n_e, "e", "left_semi").select("terms", "few", "e"))
    pairs = each.select("e", F.explode("terms").alias("term")).groupBy("e", "term").agg(F.count("*").alias("k")).where("k > 1")
    pairs = stored(pairs, "pii-pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")
    asked = sent(stored(pairs.select("term").distinct(), "pii-asked"))
    # Documents with a term, counted in one pass of partial sums, less the further copies of texts with entities.
    rows = _vocabulary(docs).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    again = found.where("c > 1").select(F.explode("terms").alias("term"), (F.col("c") - 1).alias("more")).groupBy("term").agg(F.sum("more").alias("more"))
    n_t = rows.join(again, "term", "left").select("term", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n_t"))
    texts = docs.where("text is not null").count() - (found.agg(F.sum(F.col("c") - 1)).first()[0] or 0)
    tests = pairs.count()
    k, n, share = F.col("k"), F.col("n_t"), F.col("k") / F.col("n_t")
    low = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    bits, by_chance = F.log(F.lit(float(texts)) / F.col("n_e")), n * F.col("n_e") / F.lit(float(texts))
    surprise = k * F.log(k / by_chance) - k + by_chance
    stats = pairs.join(n_e, "e").join(n_t, "term").where((k > by_chance) & (surprise > F.log(F.lit(tests / chance))) & (bits > 0) & (low >= certain))
    stats = stats.select("term", (1 + F.log(low) / bits).alias("disclosure")).where(F.col("disclosure") >= least)
    return stored(stats.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")


_TERMS = "array<struct<start:int,rank:int,end:int,disclosure:double>>"


def told_places(text: Column, told: Column) -> Column:
    """array of struct(start, rank, end, disclosure) of the words of a text, at least one, whose terms are in the map told."""

    def hits(z: Column) -> Column:
        ends = running(F.transform(z["m"], lambda w, i: F.length(F.get(z["p"], i)) + F.length(w)))
        spots = let(ends, lambda e: F.transform(z["m"], lambda w, i: F.struct((F.get(e, i) - F.length(w)).alias("start"), F.lit(4).alias("rank"), F.get(e, i).alias("end"), told[term_of(w)].alias("disclosure"))))
        return F.filter(spots, lambda x: x["disclosure"].isNotNull())

    return let(F.struct(F.split(text, WORD, -1).alias("p"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("m")), hits)


def marked(docs: DataFrame, least: float = GENERALISE) -> DataFrame:
    """docs(row, text) with spans and terms, an array of struct(start, rank, end, disclosure) in order."""
    shared_dir(docs.sparkSession)
    none = F.array().cast(_TERMS)
    telling = telling_terms(docs.select("text"), least)
    if telling.isEmpty():
        return with_spans(docs).withColumn("terms", none)
    held = _vocabulary(docs).join(sent(telling), "term").select("h", "term", "disclosure").distinct()
    held = held.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))  # at most as many as a text's words
    held = stored(held, "pii-held")
    rows = with_spans(docs).withColumn("h", F.xxhash64("text")).join(sent(held), "h", "left")
    plain = masked(F.col("text"), F.col("spans"))
    terms = F.when(F.col("told").isNotNull() & plain.rlike(WORD), told_places(plain, F.col("told"))).otherwise(none)
    return rows.select("row", "text", "spans", terms.alias("terms"))


def scan(docs: DataFrame, least: float = GENERALISE) -> DataFrame:
    """For each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and term spans), n_term, n_spans.

    Null and empty texts have no spans. Repeated rows are returned each, but count as one text. doc_id may be null. Empty table: no
    rows. Other columns are not read.
    """
    rows = marked(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text"), least)
    count = [F.size(F.filter("spans", _rank_is(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    all_spans = F.array_sort(F.concat(F.transform("spans", _short), F.transform("terms", _short)))
    n_spans = (F.size("spans") + F.size("terms")).cast("long")
    return rows.select("row.doc_id", *count, F.sha2(named(F.col("spans")), 256).alias("base_sha256"), named(all_spans).alias("spans"), F.size("terms").cast("long").alias("n_term"), n_spans.alias("n_spans"))


def _rank_is(i: int):
    return lambda x: x["rank"] == i


def _short(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))


def redact(docs: DataFrame, least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with spans of `text` replaced by tags, telling terms generalised or removed, and n_chars, if there, counted anew.

    What is left of a span that overlaps one before gets a tag of its own. Columns, whatever their names, and rows stay as they are
    otherwise.
    """
    rows = marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), least)
    tags = F.array(*[F.lit(TAGS[k]) for k in KINDS[:4]])
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.get(tags, x["rank"]).alias("tag")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.when(x["disclosure"] >= remove, F.lit("")).otherwise(F.lit(TERM_TAG)).alias("tag")))
    order = F.array_sort(F.concat(base, terms))
    text = F.when(F.size("spans") + F.size("terms") > 0, replaced(F.col("text"), order, lambda x, _: x["tag"])).otherwise(F.col("text"))
    changed = F.size("spans") + F.size("terms") > 0
    rows = rows.select("row", text.alias("text"), changed.alias("changed"))

    def value(c: str) -> Column:
        if c == "text":
            return F.col("text").alias(c)
        own = F.col("row").getField(c)
        return (F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own).alias(c)

    return rows.select(*[value(c) for c in docs.columns])

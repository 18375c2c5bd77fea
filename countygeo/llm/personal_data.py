"""Personal data: fixed shapes and bootstrapped contexts, with DataFrame functions only (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions.arrays import bind
from countygeo.runtime import checkpoint

#: Kinds in the order in which they are listed; ``learned`` spans come from contexts.
KINDS = ("email", "ip", "card", "phone", "learned")
BASE_KINDS = KINDS[:4]
# Possessive forms of the contract's patterns. A run of an expression's first class is entered at its start, or where
# the match before ended, because no later start in it can succeed where this one fails; so scans stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Words with a digit, from their first character on.
NUMBERED = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
# An instance learned from context has this many digits at least and this many characters at most.
DIGITS, LONGEST = 5, 40
# Characters of context read on either side.
REACH = 64
# Characters of a piece of text from which contexts are read; REACH at least.
BLOCK = 64
# Rounds of scoring; a pattern needs SUPPORT known instances and this share of known ones, an instance this score.
ROUNDS, SUPPORT, PRECISION, CONFIDENCE = 3, 3, 0.6, 0.8


def running_sums(values: Column) -> Column:
    """Sums of an array of longs up to each element, in one pass for each doubling of its length."""
    n = F.size(values)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(2)) - 1)).cast("int")),
                                      lambda k: F.pow(F.lit(2.0), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - step), F.lit(0).cast("long"))))


def located(text: Column, pattern: str) -> Column:
    """start, end (code points) and value of each match, from the lengths of matches and of what lies between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    size = bind(gaps, lambda g: F.transform(matches, lambda m, i: (F.length(F.get(g, i)) + F.length(m)).cast("long")))
    return bind(running_sums(size), lambda ends: F.transform(matches, lambda m, i: F.struct(
        (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"))))


def counted_below(values: Column, asked: Column, equal: bool) -> Column:
    """For each long in ``asked``, how many ``values`` are less, or at most equal: by one sort of both."""
    marks = F.concat(F.transform(values, lambda v: F.struct(v.alias("at"), F.lit(1).alias("turn"), F.lit(-1).alias("q"))),
                     F.transform(asked, lambda x, i: F.struct(x.alias("at"), F.lit(2 if equal else 0).alias("turn"), i.alias("q"))))

    def counts(line: Column) -> Column:
        seen = running_sums(F.transform(line, lambda m: F.when(m["q"] < 0, 1).otherwise(0).cast("long")))
        found = bind(seen, lambda n: F.transform(line, lambda m, i: F.struct(m["q"].alias("q"), F.get(n, i).alias("n"))))
        return F.transform(F.array_sort(F.filter(found, lambda m: m["q"] >= 0)), lambda m: m["n"])

    return bind(F.array_sort(marks), counts)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn test."""
    plain = digits(value)
    n = F.length(plain)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(plain, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _between(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


def base_spans(text: Column) -> Column:
    """kind, start, end and value of the four fixed shapes, by kind as listed, then start."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    numbered = text.rlike("[0-9]")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(numbered, F.filter(located(text, IP), lambda m: m["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))).otherwise(none),
        "card": F.when(numbered, F.filter(located(text, CARD), lambda m: F.when(_between(m["value"], 13, 19), luhn(m["value"]))
                                           .otherwise(False))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda m: _between(m["value"], 9, 15))).otherwise(none),
    }
    def named(kind: str) -> Column:
        return F.transform(found[kind], lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                                                           m["value"].alias("value")))

    return F.concat(*[named(k) for k in BASE_KINDS])


def _word(text: Column) -> Column:
    """Letters of the text in lower case; numbers become 0, so that contexts with numbers are alike."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def contexts(blocks: Column, start: Column, end: Column) -> Column:
    """Lexical patterns around a span: the two words before it, and the words on either side.

    ``blocks`` is the text in pieces of BLOCK characters, so that no span costs a walk through the whole text.
    """
    def around(at: Column) -> Column:
        k = F.floor(at / BLOCK).cast("int")
        return F.concat(*[F.coalesce(F.get(blocks, k + d), F.lit("")) for d in (-1, 0, 1)])

    def place(at: Column) -> Column:
        return at - F.greatest(F.floor(at / BLOCK) - 1, F.lit(0)) * BLOCK

    left = F.substring(around(start), F.greatest(place(start) - REACH + 1, F.lit(1)).cast("int"), F.least(place(start), F.lit(REACH)).cast("int"))
    right = F.substring(around(end), (place(end) + 1).cast("int"), F.lit(REACH))
    two = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(left, r"(\S+)\s*$", 1)
    after = F.regexp_extract(right, r"^\s*(\S+)", 1)
    whole = F.regexp_replace(F.concat(F.lit("2|"), _word(two)), r"\s+", " ")
    sides = F.concat(F.lit("1|"), _word(one), F.lit("|"), _word(after))
    return F.filter(F.array(F.when(two != "", whole), F.when((one != "") & (after != ""), sides)), lambda p: p.isNotNull())


def _instances(text: Column, base: Column) -> Column:
    """Base spans and other words with many digits: known kind or null, place, normal form and contexts."""
    words = F.when(text.rlike(f"[0-9](?:[^\\s]*[0-9]){{{DIGITS - 1}}}"), located(text, NUMBERED)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))

    def trimmed(m: Column) -> Column:
        core = F.regexp_extract(m["value"], r"[\p{L}0-9].*[\p{L}0-9]", 0)
        begin = m["start"] + F.length(F.regexp_extract(m["value"], r"^[^\p{L}0-9]*", 0))
        return F.struct(F.lit(None).cast("string").alias("kind"), begin.cast("long").alias("start"),
                        (begin + F.length(core)).cast("long").alias("end"), core.alias("value"))

    fit = F.filter(F.transform(words, trimmed), lambda w: (F.length(digits(w["value"])) >= DIGITS) & (F.length(w["value"]) <= LONGEST))

    def clear(ws: Column) -> Column:
        # As many base spans begin before the word ends as end before it begins.
        begun = counted_below(F.transform(base, lambda b: b["start"]), F.transform(ws, lambda w: w["end"]), equal=False)
        ended = counted_below(F.transform(base, lambda b: b["end"]), F.transform(ws, lambda w: w["start"]), equal=True)
        return bind(F.arrays_zip(begun.alias("begun"), ended.alias("ended")), lambda n: F.filter(
            ws, lambda w, i: F.get(n, i)["begun"] == F.get(n, i)["ended"]))

    free = bind(fit, lambda ws: F.when((F.size(ws) > 0) & (F.size(base) > 0), clear(ws)).otherwise(ws))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return bind(F.concat(base, free), lambda spans: F.when(F.size(spans) > 0, bind(blocks, lambda bs: F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("instance"),
        contexts(bs, s["start"], s["end"]).alias("patterns"))))))


def learn(edges: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, score) of the instances found by bootstrapping.

    ``edges`` are distinct (pattern, instance), ``known`` the seed instances.
    Each round scores patterns by the share of known instances beside them and,
    from the patterns that are good enough, instances by the chance that one of
    them is right; sure instances are known in the next round.
    """
    seeds = known.select("instance", F.lit(1.0).alias("score"))
    scores = seeds
    for _ in range(rounds):
        marked = edges.join(scores, "instance", "left")
        patterns = (marked.groupBy("pattern").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("right"), F.count("score").alias("support"),
                                                  F.count("*").alias("n"))
                    .where((F.col("support") >= SUPPORT) & (F.col("right") >= PRECISION * F.col("n")))
                    .select("pattern", (F.col("right") / (F.col("n") + 1)).alias("precision")))
        found = (edges.join(patterns, "pattern").groupBy("instance")
                 .agg((1 - F.exp(F.sum(F.log1p(-F.col("precision"))))).alias("score"))
                 .where(F.col("score") >= CONFIDENCE).join(seeds.select("instance"), "instance", "left_anti"))
        scores = checkpoint(seeds.unionAll(found))
    return scores.join(seeds.select("instance"), "instance", "left_anti")


def find_personal_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key and spans (kind, start, end; code points, end exclusive) of each document, from its whole text.

    Base spans are e-mail and IP addresses, card numbers by Luhn and phone
    numbers. They seed a graph of lexical patterns (words beside a span) and
    instances (other words with many digits); patterns and instances are scored
    in turn over the whole corpus, and instances that good patterns vouch for
    are ``learned`` spans.

    Null texts are empty and have no spans. Rows of the same id and text are one
    row; a null id is an id like any other. Columns of other names are ignored;
    an empty table gives no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    plain = docs.withColumn("base", base_spans(body))
    places = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    seen = checkpoint(plain.select("doc_id", "text_key", places.alias("base"), _instances(body, F.col("base")).alias("instances")))
    each = seen.select("doc_id", "text_key", F.explode("instances").alias("i")).select("doc_id", "text_key", "i.*")
    pairs = each.select("kind", "instance", F.explode("patterns").alias("pattern"))
    edges = checkpoint(pairs.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = edges.where("kind IS NOT NULL").select("instance").distinct()
    learned = learn(edges.select("pattern", "instance"), known)
    more = (each.where("kind IS NULL").join(learned.select("instance"), "instance").groupBy("doc_id", "text_key")
            .agg(F.array_sort(F.collect_set(F.struct(F.lit("learned").alias("kind"), "start", "end"))).alias("more")))
    docs_ = seen.select("doc_id", "text_key", "base").dropDuplicates(["doc_id", "text_key"]).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return docs_.join(more.alias("m"), same, "left").select("d.doc_id", "d.text_key", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

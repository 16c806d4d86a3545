"""Secret scan with a randomness test battery (operator 5, native).

Base kinds are patterns with a length rule.  The method adds tokens that look
like random keys.  Every token of ``MIN_TOKEN`` or more letters, digits and
``+/_-`` is read in the narrowest encoding that holds it (16, 32, 36 or 64
symbols; a string of digits alone is no key) and tested three ways:

- chi-squared: are the alphabet's symbols equally frequent?
- runs: does the sequence change between the halves of the alphabet as often
  as chance does?
- serial correlation: does a symbol tell anything of the next?

The three p-values are joined by Fisher's rule; a token must not be rejected
as random at ``ALPHA``.  It must also be told from running text, by the null
model of its encoding (``p_null``):

- 64: the chi-squared statistic of text grows with the token's length, by the
  excess coincidence of letters, which gives the chance that text would look
  this even (``p_text``).
- 32 and 36: words stay inside the alphabet but seldom change between letters
  and digits; the chance of that many changes is joined to ``p_text``.
- 16: the chance that text stays inside the alphabet, a number counting as one
  character.

Those p-values are cut by the Benjamini-Hochberg rule at ``FALSE_SHARE`` within
each stratum of encoding and length (powers of two), over all tokens of the
table: short tokens, which tell little, need more evidence than long ones.
Tokens of any encoding count as tested against 16, as text outside the alphabet
is what that null model expects.  The counts are a histogram of ``log p`` in
fixed bins, so that the rule needs a few numbers per stratum, however many
tokens there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of the base kinds; the length rule of ``assign`` is on its group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a match is a whole run
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN

ALPHA = 0.01
FALSE_SHARE = 0.01
TEXT_COINCIDENCE = 0.0655  # chance that two letters of running text are equal
TEXT_IN_HEX = 0.35  # chance that a letter of running text is one of a-f
TEXT_CHANGE = 0.05  # chance that text changes between letters and digits from one character to the next
BINS_PER_DECADE = 10
LAST_BIN = 400

#: Private-use characters that fence matches; a text's own ones count as the other, of equal length.
FENCE, OTHER = "\uE000", "\uE001"

HEX16, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_blocks(values: Column, body) -> Column:
    """``body`` of ``values`` (an array) cut into about as many blocks as each has items.

    What takes a step for each item of a block then takes n * sqrt(n) steps in all, not n * n.
    """
    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(v), F.greatest(size, F.lit(1)))
        return F.when(F.size(v) == 0, F.array(v)).otherwise(F.transform(firsts, lambda a: F.slice(v, a, size)))

    return let(let(values, cut), body)


def running(values: Column, zero: Column, join) -> Column:
    """For each of an int array's values: ``join`` of all values before it, from ``zero`` on."""
    def short(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(block, state, lambda s, v: F.struct(
            join(s["at"], v).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")), lambda s: s["done"])

    def both(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        return F.flatten(F.zip_with(blocks, short(totals, zero), short))

    return in_blocks(values, both)


def greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def cut_out(text: Column, ranges: Column) -> Column:
    """The texts of ``ranges`` (array<struct<start, end>>, ascending, apart from each other), in code points.

    A substring is looked for from the start of its text, so each block of ranges first gets a text of its own.
    """
    def of(block: Column) -> Column:
        first, last = F.try_element_at(block, F.lit(1))["start"], F.try_element_at(block, F.lit(-1))["end"]
        return let(F.struct(F.substr(text, first + 1, last - first).alias("text"), first.alias("first")),
                   lambda own: F.transform(block, lambda r: F.substr(
                       own["text"], r["start"] - own["first"] + 1, r["end"] - r["start"])))

    return in_blocks(ranges, lambda blocks: F.flatten(F.transform(blocks, of)))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, in code points, end exclusive."""
    fenced = F.regexp_replace(F.translate(text, FENCE, OTHER), pattern, f"{FENCE}$0{FENCE}")

    def placed(parts: Column) -> Column:
        before = running(F.transform(parts, F.char_length), F.lit(0), lambda a, b: a + b)
        spans = F.zip_with(parts, before, lambda part, at: F.struct(
            at.alias("start"), (at + F.char_length(part)).alias("end"), part.alias("found")))
        return F.filter(spans, lambda _, i: i % 2 == 1)  # text and matches take turns

    return let(F.split(fenced, FENCE), placed)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base kinds; ``kind`` is the index in KINDS."""
    def of(kind: int, pattern: str, fits) -> Column:
        return F.transform(F.filter(located(text, pattern), fits), lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def value(m: Column) -> Column:
        return F.regexp_extract(m["found"], ASSIGN, 2)

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    assign = of(0, ASSIGN, lambda m: F.char_length(value(m)) >= LEAST_VALUE)
    start = ASSIGN[:ASSIGN.index("[:=]") + 4]
    return F.concat(F.when(text.rlike(start), assign).otherwise(none),
                    F.when(text.contains("AKIA"), of(1, ACCESS, lambda m: F.lit(True))).otherwise(none),
                    F.when(text.rlike(HEX), of(2, HEX, lambda m: F.lit(True))).otherwise(none))


def _normal(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    x = F.greatest(F.lit(-13.0), F.least(F.lit(13.0), z))
    return 1 / (1 + F.exp(-(1.5976 * x + 0.070566 * x * x * x)))


def _two_sided(z: Column) -> Column:
    return F.greatest(2 * _normal(-F.abs(z)), F.lit(1e-300))


def _tests(token: Column, k: Column, symbols: Column) -> Column:
    """struct(k, p_random, p_text, p_null) of a token whose characters are the first ``k`` symbols' indices."""
    def sums(t: Column) -> Column:
        letters = F.filter(F.split(symbols, ""), lambda c: c != "")
        squares = F.aggregate(letters, F.lit(0.0), lambda a, c: a + F.pow(
            t["n"] - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        pairs = F.zip_with(F.slice(t["v"], F.lit(1), F.size(t["v"]) - 1), F.slice(t["v"], F.lit(2), F.size(t["v"]) - 1),
                           lambda a, b: a * b)
        return F.struct(
            t["n"].alias("n"), (squares * k / t["n"] - t["n"]).alias("chi"),
            (t["n"] - F.char_length(F.replace(t["halves"], F.lit("1"), F.lit("")))).alias("ones"),
            (1 + F.regexp_count(t["halves"], F.lit("01")) + F.regexp_count(t["halves"], F.lit("10"))).alias("runs"),
            F.aggregate(t["v"], F.lit(0.0), lambda a, v: a + v).alias("total"),
            F.aggregate(t["v"], F.lit(0.0), lambda a, v: a + v * v).alias("squares"),
            (F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
             + F.element_at(t["v"], 1) * F.element_at(t["v"], -1)).alias("next_to"))

    def chances(x: Column) -> Column:
        n, free = x["n"], (k - 1).cast("double")
        even = _normal((free - x["chi"]) / F.sqrt(2 * free * (n - 1) / n))
        mean = 2 * x["ones"] * (n - x["ones"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(spread > 0, _two_sided((x["runs"] - mean) / F.sqrt(spread))).otherwise(1e-300)
        varied = x["squares"] - x["total"] * x["total"] / n
        around = x["next_to"] - x["total"] * x["total"] / n
        # The circular lag-1 coefficient: mean -1 / (n - 1), variance about 1 / n.
        serial = F.when(varied > 0, _two_sided((around / varied + 1 / (n - 1)) * F.sqrt(n))).otherwise(1e-300)
        excess = (n - 1) * (k * TEXT_COINCIDENCE - 1)
        return F.struct((-(F.ln(even) + F.ln(runs) + F.ln(serial))).alias("fisher"),
                        _normal((x["chi"] - free - excess) / F.sqrt(2 * free + 4 * excess)).alias("p_text"))

    def null(p_text: Column) -> Column:
        stays = F.pow(F.lit(TEXT_IN_HEX), F.char_length(F.regexp_replace(token, "[0-9]+", "0")))
        changes = F.regexp_count(token, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"))
        usual = (F.char_length(token) - 1) * TEXT_CHANGE
        # Chernoff's bound of the Poisson tail; Fisher's rule joins it to the evenness.
        mixed = F.when(changes > usual, F.exp(changes - usual) * F.pow(usual / changes, changes)).otherwise(1.0)
        return (F.when(k == 16, stays).when(k == 64, p_text)
                .otherwise(let(p_text * mixed, lambda both: both * (1 - F.ln(both)))))

    halves = F.call_function("translate", token, symbols,
                             F.concat(F.repeat(F.lit("0"), (k / 2).cast("int")), F.repeat(F.lit("1"), (k / 2).cast("int"))))
    values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                         lambda c: F.instr(symbols, c).cast("double"))
    start = F.struct(F.char_length(token).cast("double").alias("n"), halves.alias("halves"), values.alias("v"))
    return let(let(let(start, sums), chances), lambda c: F.struct(
        k.alias("k"), (F.exp(-c["fisher"]) * (1 + c["fisher"] + c["fisher"] * c["fisher"] / 2)).alias("p_random"),
        c["p_text"].alias("p_text"), null(c["p_text"]).alias("p_null")))


def battery(token: Column) -> Column:
    """struct(k, p_random, p_text, p_null) of a token; null if it is no candidate.

    Encoding: one-case hexadecimal, upper-case base 32, lower-case base 36,
    else base 64 (the URL alphabet is read as the plain one).
    """
    k = (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32)
         .when(token.rlike("^[a-z0-9]+$"), 36).otherwise(64))

    def read(x: Column) -> Column:
        alphabet = (F.when(x["k"] == 16, HEX16).when(x["k"] == 32, BASE32).when(x["k"] == 36, BASE36)
                    .otherwise(BASE64))
        plain = F.when(x["k"] == 16, F.lower(x["t"])).otherwise(F.translate(x["t"], "-_", "+/"))
        return F.struct(x["k"].alias("k"), alphabet.alias("symbols"), plain.alias("plain"))

    scored = let(let(F.struct(token.alias("t"), k.alias("k")), read),
                 lambda x: _tests(x["plain"], x["k"], x["symbols"]))
    return F.when(~token.rlike("^[0-9]+$"), scored)


def _stratum(scored: Column, token: Column) -> Column:
    return F.concat_ws(":", scored["k"], F.floor(F.log2(F.char_length(token))))


def _bin(scored: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.floor(-BINS_PER_DECADE * F.log10(scored["p_null"]))).cast("int")


def thresholds(texts: DataFrame, column: str) -> dict[str, int]:
    """stratum -> smallest bin of log p that counts, by Benjamini-Hochberg over all tokens of the table.

    At most a few strata per encoding (by powers of two of length) and 401
    bins each are counted; what comes to the driver is one number per stratum.
    """
    tokens = (texts.filter(F.col(column).rlike(TOKEN))
              .select(F.explode(F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))).alias("token"))
              .select("token", F.explode(F.array(battery(F.col("token")))).alias("scored"))
              .filter("scored is not null"))
    counts = tokens.groupBy(_stratum(F.col("scored"), F.col("token")).alias("stratum"),
                            _bin(F.col("scored")).alias("bin")).count()
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    upper = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    encoding, length = (F.split("stratum", ":")[i] for i in (0, 1))
    tested = F.when(encoding == "16", F.sum("count").over(Window.partitionBy(length)))
    passing = (counts.withColumn("below", F.sum("count").over(down))
               .withColumn("all", F.coalesce(tested, F.sum("count").over(Window.partitionBy("stratum"))))
               .filter(upper <= FALSE_SHARE * F.col("below") / F.col("all")))
    return {r["stratum"]: r["bin"] for r in passing.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def _random_spans(text: Column, limits: dict[str, int]) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if not limits:
        return none
    # A map literal; a stratum without an accepted bin is not in it.
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    tested = F.transform(located(text, TOKEN), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"),
        battery(m["found"]).alias("scored")))
    ok = F.filter(tested, lambda m: m["scored"].isNotNull() & (m["scored"]["p_random"] >= ALPHA)
                  & F.coalesce(_bin(m["scored"]) >= F.element_at(table, _stratum(m["scored"], m["found"])),
                               F.lit(False)))
    spans = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"),
                                               m["end"].alias("end")))
    return F.when(text.rlike(TOKEN), spans).otherwise(none)


def find_secrets(documents: DataFrame, *, text_column: str = "text",
                 spans_column: str = "secret_spans") -> DataFrame:
    """``documents`` with ``secret_spans``: array<struct<start, kind, end>> by start, then kind.

    ``kind`` is an index in KINDS; positions are code points, end exclusive.
    Base spans always stay; a random token that overlaps one is that one.
    Null and empty texts have no spans; rows are judged one by one, so
    repeated rows and ids do not matter; an empty table stays empty.  Two
    passes: the table's thresholds, then the spans.
    """
    limits = thresholds(documents.select(documents[text_column].alias("text")), "text")
    text = F.coalesce(documents[text_column], F.lit(""))
    # Rows made by explode are not merged with what is computed from them: each pattern runs once.
    found = documents.select("*", F.explode(F.array(F.struct(
        base_spans(text).alias("base"), _random_spans(text, limits).alias("more")))).alias("__found"))
    every = F.array_sort(F.concat(F.col("__found")["base"], F.col("__found")["more"]))
    return found.withColumn(spans_column, let(every, without_overlaps)).drop("__found")


def without_overlaps(spans: Column) -> Column:
    """``spans`` (sorted) without the random ones that overlap a base one.

    At one start the base kinds come first.  So a random span overlaps a base
    one before it if the furthest end of those lies beyond its start, and one
    after it if the nearest start of those lies before its end.
    """
    far = (1 << 31) - 1
    ends = F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0))
    starts = F.transform(F.reverse(spans), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far))
    reach = F.zip_with(spans, running(ends, F.lit(0), greater), lambda x, end: F.struct(
        x.alias("span"), (end > x["start"]).alias("before")))
    after = F.reverse(running(starts, F.lit(far), lambda a, b: F.least(a, b)))
    reach = F.zip_with(reach, after, lambda r, start: F.struct(
        r["span"].alias("span"), (r["before"] | (start < r["span"]["end"])).alias("meets")))
    return F.transform(F.filter(reach, lambda r: (r["span"]["kind"] < 3) | ~r["meets"]), lambda r: r["span"])


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = find_secrets(documents.select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}")
              for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(spans).alias("spans"))


def redact(documents: DataFrame, *, text_column: str = "text", length_column: str | None = "n_chars",
           mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret span replaced by ``mark``; columns stay as they are.

    Overlapping spans are one; a document without spans keeps its text and
    length.  With ``length_column`` a changed text's length is written there.
    """
    columns = documents.columns
    found = find_secrets(documents, text_column=text_column, spans_column="__spans")
    text, spans = F.col(text_column), F.col("__spans")
    def between(x: Column) -> Column:
        before = running(F.transform(x, lambda m: m["end"]), F.lit(0), greater)
        gaps = F.zip_with(before, x, lambda at, m: F.struct(at.alias("start"), m["start"].alias("end")))
        after = F.struct(F.array_max(F.transform(x, lambda m: m["end"])).alias("start"), F.char_length(text).alias("end"))
        return F.concat(F.filter(gaps, lambda g: g["start"] <= g["end"]), F.array(after))

    clean = F.array_join(cut_out(text, let(spans, between)), mark)
    changed = F.size(spans) > 0
    out = found.withColumn(text_column, F.when(changed, clean).otherwise(text))
    if length_column in columns:
        out = out.withColumn(length_column, F.when(changed, F.char_length(text_column).cast("long"))
                             .otherwise(F.col(length_column)))
    return out.select(*columns)

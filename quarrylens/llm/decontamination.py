"""Operator 8, benchmark decontamination by template canonicalisation. DataFrame functions only.

A text's template is its words without punctuation, in lower case, with numbers, names (capitalised words within a
sentence) and units after numbers replaced by typed placeholders. Windows of WINDOW template words are hash-joined
with the benchmark's, and so are windows of the plain words in lower case. A window of equal plain words always
counts. One of equal template words only counts if at least half of its words are literal and its slots are
consistent: a value in the item's slots always stands for the same value in the document, along the whole alignment of
a document with an item or a run of as many of its windows as make a match. Then a question with other numbers or
names is found, and a chance likeness of templates is not.

A pair of text and item is reported if the matching windows cover RUN words of the item, or the whole of a shorter
item, or if mostly literal windows match that are as many, or all that the item has. An item of fewer than WINDOW template words is one window of its own length, looked for at every place of a text.

Searching takes every window of a document, of WINDOW words and of the lengths of shorter items, against all windows
of the items; only the texts hit are aligned window by window. Texts are keyed by their digest, so any number of
copies is aligned once. The windows of the benchmark and the digests of hit texts are broadcast only if they take
BROADCAST_BYTES at most; beyond that, the same joins are shuffled.

Results for odd input: null and empty texts match nothing, as do null and empty items; null ids are carried along;
repeated rows each give their rows, repeated item ids count as one item with the windows of all; empty tables give
an empty result; texts of any length are read whole. Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import fresh, scratch, table

WINDOW = 8
RUN = 13
BROADCAST_BYTES = 1 << 26
NAME, NUMBER, UNIT = "‹name›", "‹num›", "‹unit›"
#: Fixed list of units.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "mph kmh kph hz khz mhz ghz b kb mb gb tb w kw kwh v a j kj cal kcal pa kpa bar k percent percents dollar dollars euro euros pound pounds cent cents "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms liter liters litre litres degree degrees"
).split()


def spaced(text: Column) -> Column:
    """The text with single spaces; the signs that mark placeholders are quotes there, and count as spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s‹›]+", " "))


def canonical(text: Column) -> Column:
    """The template of a spaced text: as many words as the text has, some of them perhaps empty."""
    named = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{L}\p{N},;:)] )\p{Lu}[\p{L}'’-]*", NAME)
    numbered = F.regexp_replace(named, r"(?<![\p{L}\p{N}])[$€£+-]?[0-9][0-9.,:/]*%?(?![\p{L}\p{N}])", NUMBER)
    unit = rf"({NUMBER}[.,]?) (?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
    united = let(numbered, lambda t: F.when(t.contains(NUMBER), F.regexp_replace(t, unit, f"$1 {UNIT}")).otherwise(t))
    return F.regexp_replace(F.lower(united), r"[^\p{L}\p{N}‹› ]+", "")


def template(text: Column) -> Column:
    """The words of a spaced text's template."""
    return F.array_remove(F.split(canonical(text), " "), "")


def plain(text: Column) -> Column:
    """The words of a spaced text in lower case without punctuation but that between digits; word by word those of its template."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"(?![a-z0-9 ])(?:[^\p{L}\p{N} .,:/-]+|[.,:/-](?![0-9])|(?<![0-9])[.,:/-])", ""), " "), "")


def let(value: Column, make) -> Column:
    """make(value), with value computed once."""
    return F.transform(F.array(value), make)[0]


def window_hashes(hashes: Column, n: int) -> Column:
    """The hashes of all windows of n words, in order, from the words' hashes; empty if there are fewer words."""
    if n == 1:
        return hashes
    left, count = n // 2, F.greatest(F.size(hashes) - n + 1, F.lit(0))
    pair = lambda a, b: F.zip_with(F.slice(a, 1, count), F.slice(b, left + 1, count), lambda x, y: F.xxhash64(x, y))
    if n % 2:
        return pair(window_hashes(hashes, left), window_hashes(hashes, n - left))
    return let(window_hashes(hashes, left), lambda half: pair(half, half))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_key(hashes: Column, at: Column, n: int) -> Column:
    """One hash of the n words from place `at` (from 0); null if there are fewer."""
    return F.when(at + n <= F.size(hashes), F.xxhash64(*(F.get(hashes, at + k) for k in range(n))))


def window_keys(rows: DataFrame, keys: list[str], text: str, lengths: list[int]) -> DataFrame:
    """keys, h: window_key of all windows of the given lengths of each row, of its plain words and, where these are others, of its template words."""
    lists = rows.select(*keys, spaced(F.col(text)).alias("t")).select(*keys, word_hashes(template(F.col("t"))).alias("ch"), word_hashes(plain(F.col("t"))).alias("ph"))
    size = F.greatest(F.size("ch"), F.size("ph"))
    places = lists.select("*", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("at"))  # a where() would be computed from the text
    hashed = places.select(*keys, *(window_key(F.col(c), F.col("at"), n).alias(f"{c}{n}") for n in lengths for c in ("ph", "ch")))
    made = [F.array(F.col(f"ph{n}"), F.when(~F.col(f"ch{n}").eqNullSafe(F.col(f"ph{n}")), F.col(f"ch{n}"))) for n in lengths]
    return hashed.select(*keys, F.explode(made[0] if len(made) == 1 else F.concat(*made)).alias("h")).where("h is not null")


def within_bound(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df to be broadcast, if its rows of about row_bytes bytes keep within BROADCAST_BYTES. df is a written table, so counting is cheap."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def placed_windows(rows: DataFrame, keys: list[str], text: str, lengths: list[int] | None = None) -> DataFrame:
    """keys, size, place, template, plain, templated, h, words: all windows of each row, of its plain words and, where these are others (templated), of its template words.

    They have the given lengths; without lengths WINDOW words, or all words of a shorter template.
    """
    lists = rows.select(*keys, spaced(F.col(text)).alias("t")).select(*keys, template(F.col("t")).alias("c"), plain(F.col("t")).alias("p"))
    lists = lists.withColumns({"ch": word_hashes(F.col("c")), "ph": word_hashes(F.col("p"))})

    def of_length(n: int) -> Column:
        both = F.zip_with(window_hashes(F.col("ch"), n), window_hashes(F.col("ph"), n), lambda c, p: F.struct(c.alias("c"), p.alias("p")))
        return F.transform(both, lambda h, i: F.struct(F.lit(n).alias("size"), (i + 1).alias("place"), h.alias("h"), F.slice("c", i + 1, n).alias("template"), F.slice("p", i + 1, n).alias("plain")))

    if lengths is None:
        made = F.when(F.size("c") >= WINDOW, of_length(WINDOW))
        for n in range(1, WINDOW):
            made = made.when(F.size("c") == n, of_length(n))
    else:
        made = F.concat(*(of_length(n) for n in lengths))
    found = lists.select(*keys, F.explode(made).alias("w")).select(*keys, "w.*")
    as_plain = F.struct(F.lit(False).alias("templated"), F.col("h.p").alias("h"), F.col("plain").alias("words"))
    as_template = F.struct(F.lit(True).alias("templated"), F.col("h.c").alias("h"), F.col("template").alias("words"))
    kinds = F.when(F.col("template") == F.col("plain"), F.array(as_plain)).otherwise(F.array(as_plain, as_template))
    return found.select(*keys, "size", "place", "template", "plain", F.explode(kinds).alias("k")).select(*keys, "size", "place", "template", "plain", "k.*")


def literal_enough(words: Column) -> Column:
    return 2 * F.size(F.filter(words, lambda x: x.startswith("‹"))) <= F.size(words)


def consistent(slots: Column) -> Column:
    """Whether each item value of these lists of slots stands for one document value."""
    return let(F.array_distinct(F.flatten(slots)), lambda pairs: F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["i"]))))


def consistent_windows(met: DataFrame, needed: DataFrame) -> DataFrame:
    """digest, item, item_place of the template windows of met whose line, or a run of `needed` of whose windows, is consistent."""
    lines = met.groupBy("digest", "item", "copy", "line").agg(F.array_sort(F.collect_list(F.struct("item_place", "slots"))).alias("rows"))
    lines = lines.join(needed, "item").withColumn("starts", F.greatest(F.size("rows") - F.col("needed") + 1, F.lit(0)))
    slots = F.transform("rows", lambda x: x["slots"])
    runs = F.transform(F.slice("rows", 1, F.col("starts")), lambda _, i: consistent(F.slice(F.col("slots"), i + 1, F.col("needed"))))
    lines = lines.withColumn("slots", slots).withColumn("runs", runs).withColumn("whole", consistent(F.col("slots")))

    def within_run(i: Column) -> Column:
        first = F.greatest(i - F.col("needed") + 2, F.lit(1))
        return F.exists(F.slice("runs", first, F.greatest(F.least(i + 1, F.col("starts")) - first + 1, F.lit(0))), lambda x: x)

    counted = F.transform("rows", lambda x, i: F.when(F.col("whole") | within_run(i), x["item_place"]))
    return lines.select("digest", "item", F.explode(counted).alias("item_place")).where("item_place is not null")


def contaminated_texts(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """digest, item_id, matched_windows, coverage, reparameterised of each distinct text that holds an item."""
    spark = docs.sparkSession
    benchmark = items.select(F.col(item_col).alias("item"), F.xxhash64(item_text).alias("copy"), F.col(item_text).alias("t")).distinct()
    bench = placed_windows(benchmark, ["item", "copy"], "t").withColumn("literal", literal_enough(F.col("template"))).where("literal or not templated")
    bench = scratch(spark, bench, "benchmark-windows")
    sizes = bench.groupBy("item").agg(F.countDistinct("place").alias("n"), F.countDistinct(F.when(F.col("literal"), F.col("place"))).alias("literal_n"))
    most = F.lit(RUN - WINDOW + 1)
    lengths = sorted({WINDOW} | {r["size"] for r in bench.select("size").distinct().collect()})  # WINDOW different ones at most
    their_key = F.coalesce(*(F.when(F.col("size") == n, window_key(F.col("hashes"), F.lit(0), n)) for n in lengths))
    known = scratch(spark, bench.select("size", word_hashes(F.col("words")).alias("hashes")).select(their_key.alias("h")).distinct(), "benchmark-hashes")
    own_keys = window_keys(docs.select(F.md5(text_col).alias("digest"), F.col(text_col).alias("text")), ["digest"], "text", lengths)
    hits = own_keys.join(within_bound(known), "h", "left_semi").select("digest").distinct()
    hits = scratch(spark, hits, "hit-texts")
    found = docs.select(F.md5(text_col).alias("digest"), F.col(text_col).alias("t")).join(within_bound(hits), "digest", "left_semi")
    found = scratch(spark, found.groupBy("digest").agg(F.first("t").alias("t")), "hit-texts-whole")

    own = placed_windows(found, ["digest"], "t", lengths).select("digest", "place", "plain", "templated", "h", "words")
    theirs = bench.select("item", "copy", F.col("place").alias("item_place"), "literal", "h", F.col("words").alias("item_words"), F.col("plain").alias("item_plain"))
    met = own.join(within_bound(theirs, 1024), "h").where(F.col("words") == F.col("item_words"))
    slots = F.filter(F.zip_with("words", F.arrays_zip(F.col("item_plain").alias("i"), F.col("plain").alias("d")), lambda w, p: F.when(w.contains("‹"), p)), lambda x: x.isNotNull())
    met = met.select("digest", "item", "copy", "item_place", "literal", "templated", (F.col("place") - F.col("item_place")).alias("line"), F.when(F.col("templated"), slots).alias("slots"))
    met = scratch(spark, met, "met-windows")
    verbatim = met.where("not templated").select("digest", "item", "item_place", "literal", F.lit(False).alias("other"))
    needed = sizes.select("item", F.least("literal_n", most).cast("int").alias("needed"))
    changed = consistent_windows(met.where("templated"), needed).select("digest", "item", "item_place", F.lit(True).alias("literal"), F.lit(True).alias("other"))
    places = verbatim.union(changed).groupBy("digest", "item", "item_place").agg(F.max("literal").alias("literal"), F.min("other").alias("other"))
    matches = places.groupBy("digest", "item").agg(F.count("*").alias("matched_windows"), F.count_if("literal").alias("literal_matched"), F.max("other").alias("reparameterised"))
    all_words = F.col("matched_windows") >= F.least("n", most)
    all_literal = (F.col("literal_n") > 0) & (F.col("literal_matched") >= F.least("literal_n", most))
    matches = matches.join(sizes, "item").where(all_words | all_literal)
    return matches.select("digest", F.col("item").alias(item_col), "matched_windows", F.round(F.col("matched_windows") / F.col("n"), 6).alias("coverage"), "reparameterised")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item id, matched_windows, coverage and reparameterised of each row of docs and item that it holds."""
    matches = scratch(docs.sparkSession, contaminated_texts(docs, items, text_col, item_col, item_text), "contaminated")
    ids = docs.select(F.col(id_col), F.md5(text_col).alias("digest"))
    return ids.join(within_bound(matches), "digest").select(id_col, item_col, "matched_windows", "coverage", "reparameterised")


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows of null text stay."""
    own = fresh(docs, "digest")
    matches = contaminated_texts(docs, items, text_col).select(F.col("digest").alias(own)).distinct()
    matches = scratch(docs.sparkSession, matches, "contaminated")
    return docs.join(within_bound(matches), F.md5(text_col) == F.col(own), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Benchmark decontamination by templates, in DataFrame functions alone.

Numbers, units and names become placeholders; windows of the templates are
joined by their hashes; what counts is how many of an item's words a document
holds in their order, so that a changed word costs one word and no more; and a
match counts only if its slots agree: whatever
stands in the benchmark item's slots must map to one value each in the
document, as it does in a copy and in a question asked again with other values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

#: Words of a window.
WINDOW = 8
#: Items of so many words have windows of WINDOW words on both sides of any changed word in their middle.
LONG = 2 * WINDOW + 1
#: Windows of shorter items: (least words of the item, words of a window), so that the same holds; an item of fewer words is one window.
SHORTER = [(13, 6), (9, 4), (7, 3)]
#: So many words of a long item at one distance are a verbatim passage, whatever their share.
RUN = 13
#: A window identifies an item only with so many distinct words that are no placeholder (all of them, in shorter items: 3 at least).
LEAST_WORDS = 4
#: A document is contaminated by a long item if it holds at least this share of the item's words, or of its windows.
SHARE = 0.5
#: Windows of all items, and ids of documents to compare with short items, are broadcast only up to so many rows of 32 bytes.
BROADCAST_ROWS = 500_000
#: Placeholders for number, unit and name: characters of the private use area.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"

#: Words of units, longest first where one begins another.
UNITS = "kilometers|kilometres|kilograms|milliliters|centimeters|millimeters|kilometer|kilogram|minutes|seconds|dollars|percent|gallons|degrees|meters|metres|liters|litres|ounces|pounds|inches|months|minute|second|dollar|euros|miles|hours|years|weeks|cents|grams|yards|acres|meter|metre|liter|litre|pound|month|feet|foot|mile|hour|year|week|days|cent|euro|gram|inch|yard|kwh|mph|kmh|day|kg|km|cm|mm|ml|lb|oz|ft|mi|hz"

#: Stands for the blank inside a name of several words.
JOINT = "\ue003"
#: A word in capitals of which one letter at least is small; "McKay" and "O'Brien" are such words, "NASA" isn't.
CAPITAL = f"\\p{{Lu}}[\\p{{L}}'’{JOINT}-]*\\p{{Ll}}[\\p{{L}}'’{JOINT}-]*"

#: Fixed values: (pattern, replacement in Spark's syntax), in order, over text whose white space is single blanks. A name of
#: two or three words inside a sentence becomes one word; twice, as what a pattern has taken can't begin the next match.
JOINS = [
    (f"[{NUMBER}{UNIT}{NAME}{JOINT}]", ""),
    (f"([\\p{{Ll}},;] {CAPITAL}) ({CAPITAL})", f"$1{JOINT}$2"),
    (f"([\\p{{Ll}},;] {CAPITAL}) ({CAPITAL})", f"$1{JOINT}$2"),
]
#: The same over joined text. No step adds or takes a blank. A name is what is capitalised inside a sentence: a sentence's
#: first word can't be told from a name, so it stays a word, and what it is in a question asked again costs that word alone.
STEPS = [
    ("(^| )[-+$€£(]*[0-9][0-9.,:/]*", f"$1{NUMBER}"),
    (f"({NUMBER}[^ \\p{{L}}]*)( ?)(?:{UNITS})([^\\p{{L}}]|$)", f"$1$2{UNIT}$3"),
    (f"([\\p{{Ll}},;{NUMBER}{UNIT}] ){CAPITAL}", f"$1{NAME}"),
]
STRIPPED = f"[^ \\p{{L}}\\p{{N}}{NUMBER}{UNIT}{NAME}]+"


def plain(text: Column) -> Column:
    """Words apart by one blank; a name of several words is one word."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x20]+", " "))
    for pattern, replacement in JOINS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def template(text: Column) -> Column:
    """The words of ``plain`` text, in lower case without marks, slots as placeholders; as many as there are words."""
    for pattern, replacement in STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.split(F.regexp_replace(F.lower(text), STRIPPED, ""), " ")


def codes(words: Column) -> Column:
    """A hash for every word, so that each is read once, whatever windows it is in."""
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(words: Column, size: int) -> Column:
    """Hashes of all windows of so many codes, by place; none where there are fewer."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, size)))


def windows_of(words: Column, size: int) -> Column:
    """The same with the size and place of each window."""
    return F.transform(windows(words, size), lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("at"), h.alias("hash")))


def is_slot(word: Column) -> Column:
    return word.rlike(f"^[{NUMBER}{UNIT}{NAME}]+$")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words and size of an item's windows."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", template(plain(F.col("text"))).alias("words"))
    size = F.when(F.size("words") >= LONG, WINDOW)
    for least, k in SHORTER:
        size = size.when(F.size("words") >= least, k)
    return items.withColumn("size", size.otherwise(F.size("words")))


def item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """item_id, size, place, hash, n_windows and n_places (words in any of them) of the windows that identify an item."""
    placed = [items.where(F.col("size") == k).select("item_id", "size", "words", F.posexplode(windows(codes(F.col("words")), k)).alias("place", "hash")) for k in sizes]
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    content = F.size(F.array_distinct(F.filter(F.slice("words", F.col("place") + 1, F.col("size")), lambda w: (w != "") & ~is_slot(w))))
    telling = every.where(content >= F.when(F.col("size") < WINDOW, 3).otherwise(LEAST_WORDS)).select("item_id", "size", "place", "hash").distinct()
    return telling.join(telling.groupBy("item_id").agg(F.countDistinct("hash").alias("n_windows"), F.size(places_of(F.collect_set(F.struct("place", "size")))).alias("n_places")), "item_id")


def places_of(windows: Column) -> Column:
    """Places of an item that its windows (place and size) cover."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(w["place"], w["place"] + w["size"] - 1))))


def held_long(hits: DataFrame) -> DataFrame:
    """doc_id, item_id, held and of (words) where a document holds enough of a long item."""
    by_shift = hits.where(F.col("size") == WINDOW).groupBy("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift"), "n_windows", "n_places").agg(F.collect_set(F.struct("place", "size")).alias("windows"), F.collect_set("hash").alias("hashes"))
    placed = by_shift.withColumn("places", places_of(F.col("windows")))
    counted = placed.groupBy("doc_id", "item_id", "n_windows", "n_places").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("held"), F.size(F.array_distinct(F.flatten(F.collect_set("hashes")))).alias("n_held"), F.max(F.size("places")).alias("run"))
    enough = (F.col("held") >= SHARE * F.col("n_places")) | (F.col("n_held") >= SHARE * F.col("n_windows")) | (F.col("run") >= RUN)
    return counted.where(enough).select("doc_id", "item_id", "held", F.col("n_places").alias("of"))


def held_short(hits: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The same for short items: their small windows only say where to look, and words are compared one by one.

    Words after an added or missing one stand one place off. Needed are all words of an item of fewer than 7,
    all but one of 7 or 8, and of longer ones what half of their windows of WINDOW words would hold.
    """
    spots = stored(hits.where(F.col("size") < WINDOW).select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct(), "spots")
    wanted = spots.select("doc_id").distinct()
    # Spark takes the ids for many, as it can't see how few hits are left, and would shuffle all texts to them.
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    theirs = docs.join(wanted, "doc_id", "left_semi").select("doc_id", template(plain(F.col("text"))).alias("doc_words"))
    both = spots.join(items.select("item_id", "words"), "item_id").join(theirs, "doc_id")

    def equal(off: int) -> Column:
        def same(word: Column, i: Column) -> Column:
            at = F.col("shift") + i
            return F.coalesce((F.get("doc_words", at) == word) | (F.get("doc_words", at + off) == word), F.get("doc_words", at) == word, F.get("doc_words", at + off) == word, F.lit(False))

        return F.size(F.filter(F.transform("words", same), lambda x: x))

    n = F.size("words")
    needed = F.when(n >= 9, F.floor(n / 2) + 4).when(n >= 7, n - 1).otherwise(n)
    compared = both.select("doc_id", "item_id", n.cast("long").alias("of"), needed.alias("needed"), F.greatest(equal(1), equal(-1)).cast("long").alias("equal"))
    return compared.where(F.col("equal") >= F.col("needed")).groupBy("doc_id", "item_id", "of").agg(F.max("equal").alias("held")).select("doc_id", "item_id", "held", "of")


def slots(rows: DataFrame, key: str) -> DataFrame:
    """Places, kinds and written values of the slots of every text."""
    words = plain(F.col("text"))
    kinds = F.transform(F.arrays_zip(template(words).alias("kind"), F.split(F.lower(words), " ").alias("value")), lambda w, i: F.when(is_slot(w["kind"]), F.struct(i.alias("place"), w["kind"].alias("kind"), w["value"].alias("value"))))
    return rows.select(key, F.explode(F.array_compact(kinds)).alias("w")).select(key, "w.place", "w.kind", F.regexp_replace("w.value", "[.,;:!?()]+$", "").alias("value"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, words held and their share of the item, of what each document holds of the benchmark, slots agreeing."""
    items = items_of(benchmark)
    sizes = sorted({WINDOW, *(r.size_ for r in items.select(F.col("size").alias("size_")).distinct().collect())})  # WINDOW values at most
    wanted = item_windows(items, sizes)
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    words = docs.select("doc_id", codes(template(plain(F.col("text")))).alias("words"))
    by_size = F.flatten(F.array(*[windows_of(F.col("words"), k) for k in sizes])) if len(sizes) > 1 else None
    if by_size is None:
        placed = words.select("doc_id", F.lit(WINDOW).alias("size"), F.posexplode(windows(F.col("words"), WINDOW)).alias("at", "hash"))
    else:
        placed = words.select("doc_id", F.explode(by_size).alias("w")).select("doc_id", "w.*")
    # Hits are few; they are used more than once, and finding them is what costs.
    hits = stored(placed.join(wanted, ["hash", "size"]).select("doc_id", "item_id", "size", "at", "place", "hash", "n_windows", "n_places"), "hits")
    found = held_long(hits)
    if sizes[0] < WINDOW:
        found = found.unionByName(held_short(hits, items, docs))
    found = stored(found, "found")
    # Slots of items are few; those of documents are joined where a window of a match covers them.
    own = slots(benchmark, "item_id").select("item_id", F.col("place").alias("slot"), F.col("kind").alias("slot_kind"), F.col("value").alias("item_value"))
    covered = hits.join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").join(own, "item_id")
    covered = covered.where((F.col("slot") >= F.col("place")) & (F.col("slot") < F.col("place") + F.col("size"))).select("doc_id", "item_id", "slot_kind", "item_value", (F.col("at") + F.col("slot") - F.col("place")).alias("place"), (F.col("at") - F.col("place")).alias("shift")).distinct()
    covered = stored(covered, "covered")
    # Only documents with a slot to check are read for their slots; Spark chooses the join by the size of the files just written.
    theirs = slots(docs.join(covered.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").withColumnsRenamed({"kind": "doc_kind"})
    agreed = covered.join(theirs, ["doc_id", "place"]).groupBy("doc_id", "item_id", "shift", "slot_kind", "item_value").agg(F.countDistinct("value").alias("values"))
    broken = agreed.groupBy("doc_id", "item_id", "shift").agg((F.max("values") > 1).alias("broken")).groupBy("doc_id", "item_id").agg(F.min("broken").alias("broken")).where("broken")
    return found.join(broken, ["doc_id", "item_id"], "left_anti").select("doc_id", "item_id", "held", (F.col("held") / F.col("of")).alias("share"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for every document: contaminated, the number of items found and their ids in order.

    Null and empty texts and benchmark items without three telling words match
    nothing, nor do documents or items without an id. Rows that repeat a doc_id
    share what any of them holds. Empty tables are no error: without items
    nothing is contaminated. Other columns are left out.
    """
    found = matches(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), benchmark.select("item_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    joined = docs.select("doc_id").join(found, "doc_id", "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """The scan as SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def steps(made: str, listed: list[tuple[str, str]]) -> str:
        for pattern, replacement in listed:
            for k in "123":
                replacement = replacement.replace(f"${k}", f"\\{k}")
            made = f"regexp_replace({made}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
        return made

    plain_sql = steps("trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20]+', ' ', 'g'))", JOINS)
    made = steps(plain_sql, STEPS)
    made = f"string_split(regexp_replace(lower({made}), {quoted(STRIPPED)}, '', 'g'), ' ')"
    slot = f"regexp_matches(x, '^[{NUMBER}{UNIT}{NAME}]+$')"
    views = lambda table, key, name: f"""
{name}_w AS (SELECT {key}, {made} AS words, string_split(lower({plain_sql}), ' ') AS written FROM {table} WHERE {key} IS NOT NULL),
{name}_s AS (SELECT {key}, place, x AS kind, regexp_replace(v, '[.,;:!?()]+$', '') AS value FROM
  (SELECT {key}, unnest(range(len(words))) AS place, unnest(words) AS x, unnest(written) AS v FROM {name}_w) WHERE {slot})"""  # noqa: E731
    return f"""
WITH {views("benchmark", "item_id", "b").strip()}, {views("documents", "doc_id", "d")},
b_z AS (SELECT item_id, words, len(words) AS n, CASE WHEN len(words) >= {LONG} THEN {WINDOW} {" ".join(f"WHEN len(words) >= {least} THEN {k}" for least, k in SHORTER)} ELSE len(words) END AS size FROM b_w),
b_h AS (SELECT item_id, size, place, list_slice(words, place + 1, place + size) AS win FROM (SELECT *, unnest(range(n - size + 1)) AS place FROM b_z)),
sizes AS (SELECT DISTINCT size FROM b_z),
d_h AS (SELECT doc_id, size, spot, list_slice(words, spot + 1, spot + size) AS win FROM (SELECT *, unnest(range(len(words) - size + 1)) AS spot FROM d_w, sizes)),
wanted AS (SELECT DISTINCT item_id, size, place, win FROM b_h WHERE len(list_distinct(list_filter(win, lambda x: x <> '' AND NOT {slot}))) >= CASE WHEN size < {WINDOW} THEN 3 ELSE {LEAST_WORDS} END),
whole AS (SELECT item_id, count(DISTINCT p) AS n_places, count(DISTINCT win) AS n_windows FROM (SELECT item_id, win, unnest(range(place, place + size)) AS p FROM wanted) GROUP BY item_id),
hits AS (SELECT doc_id, item_id, w.size, spot, w.place, win FROM d_h JOIN wanted w USING (win)),
spread AS (SELECT doc_id, item_id, spot - place AS shift, win, unnest(range(place, place + size)) AS p FROM hits WHERE size = {WINDOW}),
runs AS (SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, shift, count(DISTINCT p) AS n FROM spread GROUP BY ALL) GROUP BY ALL),
long AS (SELECT doc_id, item_id FROM (SELECT doc_id, item_id, count(DISTINCT p) AS held, count(DISTINCT win) AS n_held FROM spread GROUP BY ALL) JOIN whole USING (item_id) JOIN runs USING (doc_id, item_id) WHERE held >= {SHARE} * n_places OR n_held >= {SHARE} * n_windows OR run >= {RUN}),
beside AS (SELECT doc_id, item_id, z.n, list_transform(range(z.n), lambda i: [z.words[i + 1], CASE WHEN shift + i >= 0 THEN d.words[shift + i + 1] END, CASE WHEN shift + i + 1 >= 0 THEN d.words[shift + i + 2] END, CASE WHEN shift + i > 0 THEN d.words[shift + i] END]) AS c
  FROM (SELECT DISTINCT doc_id, item_id, spot - place AS shift FROM hits WHERE size < {WINDOW}) JOIN b_z z USING (item_id) JOIN d_w d USING (doc_id)),
short AS (SELECT DISTINCT doc_id, item_id FROM beside WHERE greatest(len(list_filter(c, lambda x: coalesce(x[1] = x[2], false) OR coalesce(x[1] = x[3], false))), len(list_filter(c, lambda x: coalesce(x[1] = x[2], false) OR coalesce(x[1] = x[4], false)))) >= CASE WHEN n >= 9 THEN n // 2 + 4 WHEN n >= 7 THEN n - 1 ELSE n END),
found AS (SELECT * FROM long UNION SELECT * FROM short),
covered AS (SELECT DISTINCT doc_id, item_id, s.kind, s.value AS item_value, spot + s.place - h.place AS place, spot - h.place AS shift
  FROM hits h JOIN found USING (doc_id, item_id) JOIN b_s s USING (item_id) WHERE s.place >= h.place AND s.place < h.place + h.size),
agreed AS (SELECT c.doc_id, item_id, shift, c.kind, item_value, count(DISTINCT d.value) AS n FROM covered c JOIN d_s d USING (doc_id, place) GROUP BY ALL),
broken AS (SELECT doc_id, item_id FROM (SELECT doc_id, item_id, shift, max(n) > 1 AS b FROM agreed GROUP BY ALL) GROUP BY ALL HAVING min(b)),
kept AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM found ANTI JOIN broken USING (doc_id, item_id) GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(item_ids, '') AS item_ids FROM documents LEFT JOIN kept USING (doc_id)
"""

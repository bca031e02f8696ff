"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A paragraph is a line, cut every 512 code points; its digest is a 64-bit hash.  A sketch has 3 tables of 8 cells; each digest
goes to one cell of each table, and a cell keeps (count, xor of digests, xor of their checks).  Two versions' sketches
subtract cell by cell, which leaves the differing digests; cells that hold one digest are peeled until all are empty,
which recovers the difference.  If peeling gets stuck, the comparison is retried larger: the digests are split by another
hash over as many sub-sketches as their number asks for, each with new positions, and those that get stuck are split again.  So a
difference of d digests costs about d / 8 sketches, whatever the document's length, and the published fingerprint stays
of one size.

Paragraphs alone tell little about long lines: a line changed in its second half shares few or no 512 cuts with the old one,
and an insertion shifts all later cuts.  So texts are also compared by content-defined pieces: a text is cut after the words
(with the space behind them) whose hash is 0 modulo 4, and inside words of over 64 code points after the
characters whose hash with the two before them is 0 modulo 32, so a change moves only the cuts beside it.  Pieces are
about four words long, and too many for sketches (see ``apart``), so their digests are compared as sets; a text whose unchanged part holds no whole piece still has likeness 0.

The next document of each document needs the order of all ids.  Documents are cut into ranges of about equal numbers by
(id, text hash, row), whose bounds come from a range partitioning of those narrow keys; so outlying, repeated, null or string
ids make no large range.  Each range is sorted by itself, with the first document of the next range behind its own, so
texts are shuffled once.

Defined cases: a null text is empty; a text without a non-empty line has an empty sketch and likeness 1 to another such; equal
paragraphs of one text count once; equal ids are ordered by a hash of their texts (repeated rows follow each other); a null
id comes before all others; a single document is its own next; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, col, read

#: Code points of a line that make a paragraph of their own.
PARAGRAPH_CHARS = 512
#: One word in so many ends a piece; one character in so many does in words of more code points than the last.
PIECE_WORDS, PIECE_CHARS, LONG_WORD = 4, 32, 64
#: Rounds of peeling at one size, retries at larger sizes, digests aimed at per sub-sketch in a retry.
ROUNDS, RETRIES, GROUP = 8, 10, 8
#: Bytes of text aimed at per range of documents, and ranges at most (their bounds pass the driver).
RANGE_BYTES, MAX_RANGES = 8 << 20, 100_000
_CHECK = "xxhash64({}, 7)"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    blocks = lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(line) - 1) / PARAGRAPH_CHARS).cast("int")), lambda i: F.xxhash64(F.substring(line, i * PARAGRAPH_CHARS + 1, F.lit(PARAGRAPH_CHARS))))
    lines = F.array_remove(F.split(text, "\n"), "")
    return F.array_distinct(F.flatten(F.transform(lines, blocks)))


def pieces(text: Column) -> Column:
    """Distinct 64-bit digests of the content-defined pieces."""
    ends = lambda n, part, *context: F.when(F.pmod(F.xxhash64(part, *context), F.lit(n)) == 0, F.concat(part, F.lit("\n"))).otherwise(part)
    within = lambda cs: F.array_join(F.transform(cs, lambda c, i: ends(PIECE_CHARS, c, F.get(cs, i - 1), F.get(cs, i - 2))), "")
    inside = lambda word: F.get(F.transform(F.array(F.split(word, "")), within), 0)
    words = F.transform(F.split(text, r"(?<=[ \n])"), lambda w: F.when(F.char_length(w) > LONG_WORD, ends(PIECE_WORDS, inside(w), w)).otherwise(ends(PIECE_WORDS, w)))
    return F.array_distinct(F.transform(F.array_remove(F.split(F.array_join(words, ""), "\n"), ""), lambda p: F.xxhash64(p)))


def _bits(level: str) -> str:
    """Where the three tables' positions begin in a digest; each retry reads other bits."""
    return f"array(int(9 * ({level} % 5)), int(9 * ({level} % 5) + 3), int(9 * ({level} % 5) + 6))"


def _build(keys: str, level: str) -> str:
    return f"""flatten(transform({_bits(level)}, bit -> transform(sequence(0L, 7L), slot ->
      aggregate(filter({keys}, key -> (shiftrightunsigned(key, bit) & 7L) = slot), named_struct('c', 0, 'k', 0L, 'h', 0L),
        (sum, key) -> named_struct('c', sum.c + 1, 'k', sum.k ^ key, 'h', sum.h ^ {_CHECK.format("key")})))))"""


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


#: No digests yet, as (sign, digest) pairs.
_NONE = "slice(array(named_struct('c', 0, 'k', 0L)), 1, 0)"


def _peel(cells: str, level: str) -> str:
    """struct(cells: what is left, found: (sign, digest) pairs recovered, stop)."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.c) = 1 and x.h = {_CHECK.format('x.k')}), x -> named_struct('c', x.c, 'k', x.k)))"
    remove = f"(z, p) -> named_struct('c', z.c - p.c, 'k', z.k ^ p.k, 'h', z.h ^ {_CHECK.format('p.k')})"
    tables = f"flatten(transform({_bits(level)}, (bit, table) -> transform(slice(t.cells, 8 * table + 1, 8), (x, slot) -> aggregate(filter(pures, p -> (shiftrightunsigned(p.k, bit) & 7L) = slot), x, {remove}))))"
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', {_NONE}, 'stop', false), (s, i) -> if(s.stop, s,
      aggregate(array({pure}), s, (t, pures) -> if(size(pures) = 0, named_struct('cells', t.cells, 'found', t.found, 'stop', true),
        named_struct('cells', {tables}, 'found', concat(t.found, pures), 'stop', false)))))"""


def difference(a: str, b: str, a_cells: str, b_cells: str) -> str:
    """SQL of the symmetric difference of two digest arrays, by subtracting and peeling their sketches: an array of
    (c, k), c = 1 for a digest k of ``a`` alone and -1 for one of ``b`` alone."""
    empty = "forall({}, x -> x.c = 0 and x.k = 0L and x.h = 0L)"
    first = _peel(_subtract(a_cells, b_cells), "0")
    # both sides' sketches are bound by one transform, so the long expressions stand here once
    inner = f"element_at(transform(array(transform(array(g.a, g.b), ks -> {_build('ks', 'level')})), cc -> {_peel(_subtract('cc[0]', 'cc[1]'), 'level')}), 1)"
    whole = f"array(named_struct('a', {a}, 'b', {b}))"
    start = f"element_at(transform(array({first}), one -> if({empty.format('one.cells')}, named_struct('todo', slice({whole}, 1, 0), 'found', one.found), named_struct('todo', {whole}, 'found', {_NONE}))), 1)"
    # a stuck group is split by another hash into parts of about GROUP digests, each sketched, subtracted and peeled
    split = lambda side: f"filter(grp.{side}, d -> pmod(xxhash64(d, level), n) = j)"
    parts = f"flatten(transform(state.todo, grp -> flatten(transform(array(greatest(2L, bigint(size(grp.a) + size(grp.b)) div {GROUP})), n -> transform(sequence(0L, n - 1L), j -> named_struct('a', {split('a')}, 'b', {split('b')}))))))"
    results = f"transform({parts}, g -> named_struct('g', g, 'p', {inner}))"
    alone = lambda x, y, sign: f"transform(array_except(grp.{x}, grp.{y}), k -> named_struct('c', {sign}, 'k', k))"
    return f"""aggregate(sequence(1, {RETRIES}), {start}, (state, level) -> if(size(state.todo) = 0, state,
          aggregate(array({results}), state, (st, rs) -> named_struct(
            'todo', transform(filter(rs, r -> not {empty.format("r.p.cells")}), r -> r.g),
            'found', concat(st.found, flatten(transform(filter(rs, r -> {empty.format("r.p.cells")}), r -> r.p.found)))))),
          state -> concat(state.found, flatten(transform(state.todo, grp -> concat({alone("a", "b", "1")}, {alone("b", "a", "-1")})))))"""


def sketches(*keys: str) -> Column:
    """Array of the sketches of several digest arrays."""
    return F.expr(f"transform(array({', '.join(keys)}), ks -> {_build('ks', '0')})")


def differences(sketched: str, *pairs: tuple[int, str, int, str]) -> Column:
    """Array of ``difference`` of (place in ``sketched``, digests) pairs."""
    each = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'p', {sketched}[{i}], 'q', {sketched}[{j}])" for i, x, j, y in pairs)
    return F.expr(f"transform(array({each}), pr -> {difference('pr.x', 'pr.y', 'pr.p', 'pr.q')})")


def apart(a: str, b: str) -> Column:
    """``difference`` by set operations, linear in the number of digests: texts have many more pieces than paragraphs."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def likeness(na: Column, nb: Column, diff: Column) -> Column:
    """Jaccard similarity from the sizes of two sets and of their difference."""
    return F.when(na + nb == 0, F.lit(1.0)).otherwise((na + nb - diff) / (na + nb + diff))


def as_text(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> concat_ws(':', hex(x.c), hex(x.k), hex(x.h))), ' ')")


def range_bounds(narrow: DataFrame) -> tuple[str, int]:
    """(JSON, number) of the first sort keys of ranges of about equal numbers of documents, from a range partitioning of
    the narrow keys (doc_id, h, u; n: bytes); one row a range goes to the driver, at most MAX_RANGES."""
    total = narrow.agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGES, max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES + 1))
    first = narrow.repartitionByRange(ranges, "doc_id", "h", "u").groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "h", "u")).alias("k"))
    found = first.agg(F.to_json(F.sort_array(F.collect_list("k")), {"ignoreNullFields": "false"}), F.count(F.lit(1))).first()
    return found[0] or "[]", found[1]


def range_of(key: str, bounds: Column, n: int) -> tuple[Column, Column]:
    """(how many of the ``n`` sorted bounds are not above the column ``key``, by binary search; the column of the bounds)."""
    step = f"if(acc.lo >= acc.hi, acc, if({{b}}[(acc.lo + acc.hi) div 2] <= {key}, named_struct('lo', int((acc.lo + acc.hi) div 2 + 1), 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', int((acc.lo + acc.hi) div 2))))"
    bound = "bounds_"
    search = f"aggregate(sequence(1, {max(1, n).bit_length() + 1}), named_struct('lo', 0, 'hi', {n}), (acc, i) -> {step.format(b=bound)}, acc -> bigint(acc.lo))"
    return F.expr(search), bounds.alias(bound)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text): adds the digests ``a`` and the next document's ``next_text`` and digests ``b``; the first follows the last."""
    shelf = Shelf(docs.sparkSession, "fingerprints")
    # written once, so that a row's number is the same whenever it is read
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = shelf.put(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"), F.octet_length(text).cast("long").alias("n")))
    json, n = range_bounds(docs.select("doc_id", "h", "u", "n"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.from_json(F.lit(json), f"array<struct<doc_id:{kind},h:bigint,u:bigint>>")
    search, bounds = range_of("key", given, n)
    key = [F.lit(0).alias("guest"), "doc_id", "h", "u", "text"]
    rows = docs.select(*key, F.struct("doc_id", "h", "u").alias("key"), bounds).select("guest", "doc_id", "h", "u", "text", search.alias("range"))
    # the first document of each range is a guest at the end of the range before it (of the last, if it is the first of all)
    first = docs.sparkSession.range(1).select(F.posexplode(given).alias("pos", "k")).select(F.col("k.u").alias("u"), F.when(F.col("pos") == 0, F.lit(n)).otherwise(F.col("pos")).cast("long").alias("range"))
    guests = docs.join(F.broadcast(first), "u").select(F.lit(1).alias("guest"), "doc_id", "h", "u", "text", "range")
    both = rows.unionByName(guests).withColumn("a", digests(F.col("text")))
    w = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h", "u")
    ranged = both.withColumn("next_text", F.lead("text").over(w)).withColumn("b", F.lead("a").over(w))
    return ranged.filter("guest = 0").select("doc_id", "text", "a", "next_text", "b")


def compare(pairs: DataFrame) -> DataFrame:
    """The rows of ``with_next``: fingerprints and likenesses of each text, its edited text and the next text.

    ``near_edited`` and ``near_next`` go by paragraphs, ``near_edited_pieces`` and ``near_next_pieces`` by pieces.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next text.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "a", "b", "next_text")
    df = df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("e"), "a", "b", *(pieces(F.col(t)).alias(k) for t, k in (("text", "pa"), ("edited", "pe"), ("next_text", "pb"))))
    df = df.withColumn("sk", sketches("a", "e", "b"))
    df = df.withColumns({"found": differences("sk", (0, "a", 1, "e"), (0, "a", 2, "b")), "dpe": apart("pa", "pe"), "dpb": apart("pa", "pb")})
    df = df.withColumns({"sa": F.col("sk")[0], "se": F.col("sk")[1], "de": F.size(F.col("found")[0]), "db": F.size(F.col("found")[1])})
    size = lambda k: F.size(k).cast("double")
    return df.select("doc_id", "n_chars", "edited_sha256", as_text("sa").alias("fingerprint"), as_text("se").alias("edited_fingerprint"), likeness(size("a"), size("e"), F.col("de")).alias("near_edited"), likeness(size("a"), size("b"), F.col("db")).alias("near_next"), likeness(size("pa"), size("pe"), F.col("dpe")).alias("near_edited_pieces"), likeness(size("pa"), size("pb"), F.col("dpb")).alias("near_next_pieces"))


def changes(versions: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Per row of two text columns: ``removed`` and ``added``, the digests of the paragraphs that only one version has,
    recovered from the difference of the two sketches."""
    both = versions.select(*(col(c) for c in versions.columns), digests(F.coalesce(col(old), F.lit(""))).alias("_a"), digests(F.coalesce(col(new), F.lit(""))).alias("_b"))
    both = both.withColumn("_sk", sketches("_a", "_b")).withColumn("_found", differences("_sk", (0, "_a", 1, "_b"))[0])
    signed = lambda c: F.array_sort(F.transform(F.filter("_found", lambda x: x["c"] == c), lambda x: x["k"]))
    return both.select(*(col(c) for c in versions.columns), signed(1).alias("removed"), signed(-1).alias("added"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(col("doc_id"), col("text"))
    return compare(with_next(docs))

"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line (by doc_id, nulls last, then text hash, then line number) is
equal to it or, for lines of `min_chars` code points or more, within `max_edits` edits (insert, delete or change of a code point). "Earlier" looks at
the first occurrence of each distinct line; a dropped line still counts as earlier for others, so
the result does not depend on the order of work. Lines of any length meet their equals; blank lines are no repeats of each other and stay.

Near lines: of two lines within k edits, cut into k + 1 parts by the shorter one, some part is whole in both, and no further from
its place than the edits before and after it allow. So only lines of which a part recurs go on, without
that part, and for k = 1 are cut again into finer blocks, each of which may hold the edit, until SHORT code points are left. What is left of a
line emits its variants: what up to k deletions make of it, each a change (its place is kept) or a
surplus of one side, hashed together with what is shared. Equal variants are joined, the distance is verified on the texts, and the
earliest stays. Groups of equal variants are never paired: each member meets the earliest only,
which is within k edits of all it may stand for by the choice of keys. For k = 1 the work on a line grows
with its length; for more edits with the k-th power of that, so they are meant for short lines. Work on a document grows with its number of lines.

Defined cases: a null text stays null with 0
lines; rows equal in id and text are one document and all have its result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import KEY, cut, document_key

MIN_CHARS = 16
MAX_EDITS = 1
SHORT = 16
FINE, FINER = 4, 16
GAPLESS = r"[^\x20\x09-\x0D]"
PLACE = [*KEY, "line_no"]
SHORTER, LONGER = 0, 1


def slots(k: int) -> list[tuple[int, int, int, int]]:
    """(side, difference in length, part, shift) of the parts that may be whole in both of two lines. A line is the shorter one of all its pairs in one way, the longer one in several."""
    out = [(SHORTER, 0, p, 0) for p in range(k + 1)]
    for diff in range(k + 1):
        for p in range(k + 1):
            out += [(LONGER, diff, p, s) for s in range(-p, p + 1) if abs(diff - s) <= k - p and (diff or s)]
    return out


def _bounds(x, slot, k: int):
    """Length of the shorter line, and where a slot's part begins and ends in x."""
    side, diff, p, shift = slot
    c = F.char_length(x) - (diff if side == LONGER else 0)
    return c, F.floor(c * p / (k + 1)).cast("int") + shift, F.floor(c * (p + 1) / (k + 1)).cast("int") + shift


def _key(x, slot, k: int, *more):
    """Hash of a part with what tells where it stands; null where the part does not fit in x."""
    c, start, end = _bounds(x, slot, k)
    return F.when((c >= 0) & (start >= 0) & (end <= F.char_length(x)), F.xxhash64(*more, F.lit(slot[2]), c, F.substring(x, start + 1, end - start)))


def _left(x, slot, k: int):
    """What is left of x without a part, and how far into x that begins."""
    _, start, end = _bounds(x, slot, k)
    ahead, behind = F.substring(x, F.lit(1), start), F.substring(x, end + 1, F.char_length(x))
    p = slot[2]
    return behind if p == 0 else ahead if p == k else F.concat(ahead, F.lit("\x00"), behind), end if p == 0 else F.lit(0)


def _lines(docs: DataFrame, min_chars: int, k: int) -> DataFrame:
    """The first place of each distinct line that is not blank, and its part keys (null for lines that only meet their equals)."""
    keyed = docs.select(*document_key(), "text")
    rows = keyed.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(GAPLESS))
    keys = F.when(F.char_length("line") >= min_chars, F.array(*[_key(F.col("line"), s, k) for s in slots(k)]))
    named = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("b"), F.col("line"), F.char_length("line")).alias("h2"), F.struct(F.struct(*PLACE).alias("at"), keys.alias("keys")).alias("f"))
    return cut(named.groupBy("h1", "h2").agg(F.min("f").alias("f")).select("f.at.*", "f.keys"), "lines")


def _flags(places: DataFrame) -> DataFrame:
    """Places -> a row per document: a byte per line up to the last of them, so that each line is looked up in constant time."""
    lines = places.groupBy(*KEY).agg(F.array_sort(F.collect_list("line_no")).alias("k"))
    gaps = F.transform("k", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get("k", i - 1)).otherwise(-1) - 1), F.lit("1")))
    return lines.select(*KEY, F.to_binary(F.array_join(gaps, ""), F.lit("utf-8")).alias("flags"))


def _flagged(flags, i):
    return F.substring(flags, i + 1, F.lit(1)) == F.lit(b"1")


def _recurring(rows: DataFrame, place=None) -> DataFrame:
    """Keys that a shorter line shares with another line, longer or of its length. A line may meet itself where parts move; `place` tells."""
    n = [F.sum((F.col("side") == s).cast("long")).alias(f"n{s}") for s in (SHORTER, LONGER)]
    two = [] if place is None else [(F.min(place) < F.max(place)).alias("two")]
    fits = (F.col("n0") > 1) | (F.col("n0") > 0) & (F.col("n1") > 0)
    return rows.groupBy("key").agg(*n, *two).where(fits & F.col("two") if two else fits).select("key")


def _blocks(x):
    """For one edit: (key, x, off) of each of FINE or FINER blocks of x that may hold it, the key naming all beside the block."""
    longer, m = F.col("side"), F.char_length(x)
    c = m - longer
    n = F.when(c > 128, F.lit(FINER)).otherwise(F.lit(FINE))

    def block(j):
        start, end = F.floor(c * j / n).cast("int"), F.floor(c * (j + 1) / n).cast("int") + longer
        key = F.xxhash64("key", c, j, F.substring(x, F.lit(1), start), F.lit("\x00"), F.substring(x, end + 1, m))
        return F.struct(key.alias("key"), F.substring(x, start + 1, end - start).alias("x"), (F.col("off") + start).alias("off"))

    return F.transform(F.sequence(F.lit(0), n - 1), block)


def _cut_again(have: DataFrame) -> DataFrame:
    """Rows (at, key, side, diff, x, off) with less left of x; only those whose new key recurs. For one edit."""
    rows = have.select("at", "side", "diff", F.explode(_blocks(F.col("x"))).alias("p")).select("at", "side", "diff", "p.*")
    return cut(rows.join(_recurring(rows), "key", "left_semi"), "line-parts")


def _variants(have: DataFrame, k: int) -> DataFrame:
    """who, side, diff, v: a row for each variant that may meet one of another line."""
    who = F.struct("at", "off", "x")
    each = F.when(F.col("side") == SHORTER, F.sequence(F.lit(0), F.lit(k))).otherwise(F.array("diff"))
    start = have.select(who.alias("who"), "key", "side", F.explode(each).alias("diff"), F.col("x").alias("w"))
    level, out = start.select("*", F.lit(0).alias("pos"), F.lit("").alias("subs"), F.lit(0).alias("g"), F.lit(0).alias("e")), None
    longer = F.col("side") == LONGER
    # changes and surplus characters of both lines, if this one has g changes and e surplus ones in the end
    cost = lambda g, e: F.when(longer, g + 2 * F.greatest(e, F.col("diff")) - F.col("diff")).otherwise(g + 2 * e + F.col("diff"))
    for step in range(k + 1):
        whole = (~longer | (F.col("e") >= F.col("diff"))) & ((F.col("diff") > 0) | (F.col("g") + F.col("e") > 0))
        said = level.where(whole).select("who", "side", "diff", F.xxhash64("key", "diff", F.col("e") - F.when(longer, F.col("diff")).otherwise(0), "subs", "w").alias("v"))
        out = said if out is None else out.unionByName(said)
        if step == k:
            break
        level = level.where((cost(F.col("g") + 1, F.col("e")) <= k) | (cost(F.col("g"), F.col("e") + 1) <= k))
        spots = F.when(F.char_length("w") > F.col("pos"), F.sequence(F.col("pos"), F.char_length("w") - 1))
        gone = F.transform(spots, lambda i: F.struct(i.alias("pos"), F.concat(F.substring("w", F.lit(1), i), F.substring("w", i + 2, F.char_length("w"))).alias("w")))
        kinds = F.array(
            F.when(cost(F.col("g") + 1, F.col("e")) <= k, F.struct(F.lit(1).alias("g"), F.lit(0).alias("e"))), F.when(cost(F.col("g"), F.col("e") + 1) <= k, F.struct(F.lit(0).alias("g"), F.lit(1).alias("e")))
        )
        level = level.withColumn("n", F.explode(gone)).withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
        subs = F.when(F.col("kind.g") == 1, F.concat("subs", F.lit(","), F.col("n.pos"))).otherwise(F.col("subs"))
        level = level.select("who", "key", "side", "diff", F.col("n.w").alias("w"), F.col("n.pos").alias("pos"), subs.alias("subs"), (F.col("g") + F.col("kind.g")).alias("g"), (F.col("e") + F.col("kind.e")).alias("e"))
    return out


def _near(docs: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """Places of the distinct lines that have an earlier line at edit distance 1 to k."""
    kinds = slots(k)
    slot = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("slot") + 1)
    keyed = lines.where("keys is not null").select(*PLACE, F.posexplode("keys").alias("slot", "key")).where("key is not null").withColumn("side", slot([s[0] for s in kinds]))
    some = cut(keyed.join(_recurring(keyed, F.struct(*PLACE) if k > 1 else None), "key", "left_semi").select(*PLACE, "slot", "key", "side"), "line-parts")
    asked = docs.select(*document_key(), "text").join(_flags(some.select(*PLACE).distinct()), KEY).dropDuplicates(KEY)
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    found = asked.select(*KEY, F.explode(F.filter(each, lambda x: _flagged(F.col("flags"), x.line_no))).alias("l")).select(*KEY, "l.*")
    found = cut(found, "line-texts")
    have = some.join(found, PLACE)
    rest = [_left(F.col("line"), s, k) for s in kinds]
    choose = lambda values: F.coalesce(*[F.when(F.col("slot") == i, v) for i, v in enumerate(values)])
    have = have.select(F.struct(*PLACE).alias("at"), "key", "side", slot([s[1] for s in kinds]).alias("diff"), choose([r[0] for r in rest]).alias("x"), choose([r[1] for r in rest]).alias("off"))
    have, done = cut(have, "line-rests"), []
    shorter = F.char_length("x") - F.when(F.col("side") == LONGER, F.col("diff")).otherwise(0)  # the same for both sides
    while k == 1:
        done.append(have.where(shorter <= SHORT))
        have = have.where(shorter > SHORT)
        if have.isEmpty():
            break
        have = _cut_again(have)
    short = have
    for d in done:
        short = short.unionByName(d)
    variants = _variants(short, k)
    met = variants.groupBy("v").agg(F.count("*").alias("n"), *[F.min(F.when(F.col("side") == s, F.col("who"))).alias(f"first{s}") for s in (SHORTER, LONGER)]).where("n > 1").drop("n")
    other = F.when(F.col("side") == SHORTER, F.col("first1")).otherwise(F.col("first0"))
    mate = F.when(F.col("diff") == 0, F.least("first0", "first1")).otherwise(other)
    pairs = variants.join(met, "v").withColumn("mate", mate).where(F.col("mate.at") < F.col("who.at")).select("who", "mate").distinct()
    pairs = pairs.select("who.at.*", F.col("who.off").alias("off"), F.col("who.x").alias("x"), *[F.col(f"mate.at.{c}").alias(f"g_{c}") for c in PLACE], F.col("mate.off").alias("g_off"), F.col("mate.x").alias("g_x"))
    both = pairs.join(found, PLACE).join(found.select(*[F.col(c).alias(f"g_{c}") for c in PLACE], F.col("line").alias("earlier")), [f"g_{c}" for c in PLACE])
    if k == 1:  # what was cut off is a beginning and an end: those must be equal, and what is left within one edit
        ahead = lambda x, off: F.substring(x, F.lit(1), off)
        behind = lambda x, off, rest: F.substring(x, off + F.char_length(rest) + 1, F.char_length(x))
        same = (ahead("line", F.col("off")) == ahead("earlier", F.col("g_off"))) & (behind("line", F.col("off"), "x") == behind("earlier", F.col("g_off"), "g_x"))
        return both.where(same & (F.levenshtein("x", "g_x") <= 1)).select(*PLACE).distinct()
    distance = F.levenshtein("line", "earlier", k)
    return both.where((distance >= 0) & (distance <= k)).select(*PLACE).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """key columns, doc_id, text (what stays), n_lines, n_dropped for each document row."""
    lines = _lines(docs, min_chars, max_edits)
    near = cut(_near(docs, lines, max_edits), "near-lines")
    stay = _flags(lines.select(*PLACE).join(near, PLACE, "left_anti"))
    texts = docs.select(*document_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = texts.join(stay, KEY, "left").withColumn("all", F.split("text", "\n", -1))
    flags = F.coalesce("flags", F.lit(b""))
    both = both.withColumn("kept", F.filter("all", lambda x, i: ~x.rlike(GAPLESS) | _flagged(flags, i)))
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return both.select(*KEY, "doc_id", F.array_join("kept", "\n").alias("text"), size("all").alias("n_lines"), (size("all") - size("kept")).alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """The documents, with their own columns and text less its repeated lines.

    A document that lost lines and keeps none but blank ones is a copy, and goes, as do all but one of rows equal in id and text. n_chars, where there is such a column, is brought up to date.
    """
    says = F.col("text").rlike(r"(?U)\S")
    done = dedup_lines(docs.dropDuplicates(["doc_id", "text"]), min_chars, max_edits).where((F.col("n_dropped") == 0) | says).select(*KEY, F.col("text").alias("__k_kept"))
    keyed = docs.select("*", *document_key()).dropDuplicates(KEY)
    new = {c: F.col(c) for c in docs.columns} | {"text": F.col("__k_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("__k_kept").cast(docs.schema["n_chars"].dataType)
    return keyed.join(done, KEY).select(*[new[c].alias(c) for c in docs.columns])

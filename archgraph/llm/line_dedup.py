"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Two lines are linked at an edit distance of at most ``max_edits`` (2) code points, or of
``SHORT_EDITS`` (1) where the shorter one has under ``min_chars`` (20); lines of under
``SHORT_CHARS`` (10) code points only when identical: one edit in ten is the most. A class of lines is what links
reach, and of a class the first occurrence, by (doc_id, text, line number), stays.

1. Lines are made distinct by hash, with a map-side part, into a table in the shared folder:
   the one shuffle that moves all text.
2. A line of length l is cut into ``max_edits + 1`` even segments; each is filed under
   (segment number, l, its hash). If two lines are within ``max_edits``, some segment of
   the shorter one stands unchanged in the longer one, at a place that few shifts allow
   (the multi-match-aware bounds of Li et al., "Pass-Join", 2011). So a line looks, for
   each length l up to ``max_edits`` below its own, under a few substrings of its own.
3. Each key's filed lines are tied to the key's smallest line where that is a verified link:
   one aggregate and one join. Lines tied to one leader are linked already, and never meet
   again, so a dense group of near copies costs a star and not all its pairs.
4. What is left meets under its keys: what lines look under is joined with a table of one row
   for each key that lines are filed under, and only what meets another line is written. Where several
   lines are filed under a key, those of one leader never meet each other, so the lines that aren't of the key's most
   frequent leader are what costs. Up to ``BOUND`` of them under a key meet all of its lines.
   Under any other key, as the words of a template make it, lines are filed again, by parts of
   their counts of letters: of ``2 * max_edits + 2`` parts of the counts' bits two near lines agree on two at least, and
   meet only there, under the first that they agree on, or, where over ``DIRECT`` lines agree on that, under the first two.
   A line that nothing meets under one part isn't filed any further. What is left are lines that agree on a segment and on most letters.
5. Pairs are compared by the counts of letters, which an edit hardly changes; then common
   ends are stripped, and a banded bit-parallel Levenshtein (Hyyrö, 2003) over the rest verifies the distance: one column
   of the band is one step on two bit vectors of 2 * max_edits + 1 bits. The first columns
   are run alone, and few pairs come through them.
6. Links become classes (components.py); occurrences join their class, and all but the
   first are to be removed.

Defined cases: very long lines and texts are cut and compared whole; lines of one template, however many, are
compared only where their letters agree, too; null texts are one empty line; lines without a character other than white
space are never judged, and stay; rows with one doc_id and different texts are different
documents, told apart by the text's hash, and rows that are alike in both are one; null ids sort
first; an empty table gives no rows; other columns pass through no further, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, in_few_files, look_up, materialize, ranges_of, shared_path
from .components import connected_components

MAX_EDITS = 2
MIN_CHARS = 20
#: Lines from so many code points on are near at so many edits, if shorter than ``min_chars``.
SHORT_CHARS, SHORT_EDITS = 10, 1


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, version, line_no, line`` of each line with a character other than white space; ``version`` tells the texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


#: Characters whose counts two near lines must nearly share. Any would do; these tell most lines apart.
BAG = "etaoinsrhldcumfpgwybvkxjqz012345"


def letter_bag(line: str) -> str:
    """SQL for the counts of the characters of ``BAG`` modulo 4, each in Gray code, in the bits of a long: as many bits differ as counts do."""
    counts = (f"(octet_length({line}) - octet_length(replace({line}, '{x}', '')) & 3)" for x in BAG)
    return " | ".join(f"shiftleft(cast({c} ^ {c} div 2 as bigint), {2 * k})" for k, c in enumerate(counts))


def bags_near(a: str, b: str, max_edits: int) -> str:
    """SQL that holds for any two lines within ``max_edits``: an edit changes two counts by one at most."""
    return f"bit_count({a} ^ {b}) <= {2 * max_edits}"


#: So many lines of a key meet all others under it; a key with more is told apart by letters.
BOUND = 16
#: Rows of a key that others meet in one task.
PART = 512
#: So many lines of a key that agree on one part of their letters meet all others that do; where more do, they are told apart by a second part.
DIRECT = 64


def placed(max_edits: int, delta: str, i: str) -> tuple[str, str]:
    """SQL for (start from 1, length) of even segment ``i`` of a line ``delta`` shorter than ``n``; the last ones are one longer."""
    parts = max_edits + 1
    short = f"({parts} - (n - {delta}) % {parts})"  # so many segments have the lesser length
    length = f"((n - {delta}) div {parts})"
    return f"cast(1 + ({i} - 1) * {length} + greatest({i} - 1 - {short}, 0) as int)", f"cast({length} + if({i} > {short}, 1, 0) as int)"


def places(max_edits: int) -> list[tuple[int, int, int]]:
    """(length below the own, segment, shift) of each substring that a line looks under."""
    out = []
    for delta in range(max_edits + 1):
        for i in range(1, max_edits + 2):
            low = max(-(i - 1), delta - (max_edits + 1 - i))
            high = min(i - 1, delta + (max_edits + 1 - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


def _place_table(max_edits: int, all_: bool = True) -> str:
    """SQL for an array of the places at which lines are filed, and unless not ``all_`` of the others under which they look."""
    filed = [(0, i, 0) for i in range(1, max_edits + 2)]
    rows = [(*p, True) for p in filed] + [(*p, False) for p in places(max_edits) if all_ and p not in filed]
    return "array(" + ", ".join(f"named_struct('delta', {d}, 'i', {i}, 'shift', {s}, 'filed', {str(f).lower()}, 'edits', {max_edits})" for d, i, s, f in rows) + ")"


def _cut(edits: str) -> tuple[str, str]:
    """SQL for (start, size) of the place (delta, i, shift) of a line of ``n`` code points."""
    start, size = placed(int(edits), "delta", "i")
    return f"{start} + shift", size


def _by_edits(max_edits: int) -> tuple[str, str]:
    """As ``_cut``, by a column ``edits`` of those that lines are allowed."""
    allowed_ = sorted({min(SHORT_EDITS, max_edits), max_edits})
    cuts = [_cut(str(x)) for x in allowed_]
    if len(cuts) == 1:
        return cuts[0]
    return tuple(f"if(edits = {allowed_[0]}, {few}, {many})" for few, many in zip(*cuts))


def _keys(lines: DataFrame, max_edits: int, min_chars: int, all_: bool = True) -> DataFrame:
    """``h, filed, key``: what each line is filed under, and unless not ``all_`` what else it looks under.

    A line looks under the keys it is filed under too. One small expression over a generator
    of places, which compiles well. Lines of under ``min_chars`` are cut into fewer segments;
    one that is a little longer looks among them.
    """
    short_edits = min(SHORT_EDITS, max_edits)
    short, long_ = _place_table(short_edits, all_), _place_table(max_edits, all_)
    rows = f"if(n < {min_chars}, {short}, if(n >= {min_chars + short_edits}, {long_}, concat({short}, {long_})))"
    each = lines.select("h", "line", "n", F.expr(f"inline({rows})"))
    each = each.where(f"if(n - delta >= {min_chars}, edits = {max_edits}, edits = {short_edits} and n - delta >= {SHORT_CHARS})" if short_edits < max_edits else f"n - delta >= {min(SHORT_CHARS, min_chars)}")
    start, size = _by_edits(max_edits)
    each = each.selectExpr("h", "line", "n", "delta", "i", "filed", f"{start} as start", f"{size} as size")
    each = each.where("start >= 1 and start + size - 1 <= n")
    # Of a line without wider characters the bytes are cut out, which needs no count of those before them.
    part = "if(octet_length(line) = n, substring(cast(line as binary), start, size), cast(substring(line, start, size) as binary))"
    return each.selectExpr("h", "filed", f"xxhash64(i, n - delta, {part}) as key")


def allowed(a: str, b: str, max_edits: int, min_chars: int) -> str:
    """SQL for the edits at which two lines are near."""
    return f"if(least(char_length({a}), char_length({b})) < {min_chars}, {min(SHORT_EDITS, max_edits)}, {max_edits})"


#: Steps of the search for the length of common ends: lines of up to 2 ** 31 characters.
_STEPS = "array(" + ", ".join(str(1 << b) for b in range(30, -1, -1)) + ")"


def common_prefix(a: str, b: str, most: str) -> str:
    return f"aggregate({_STEPS}, 0, (t, s) -> if(s <= ({most}) - t and substring({a}, t + 1, s) = substring({b}, t + 1, s), t + s, t))"


def common_suffix(a: str, b: str, most: str) -> str:
    return f"aggregate({_STEPS}, 0, (t, s) -> if(s <= ({most}) - t and substring({a}, char_length({a}) - t - s + 1, s) = substring({b}, char_length({b}) - t - s + 1, s), t + s, t))"


#: Columns that are run alone first.
FIRST_COLUMNS = 16


def banded_distance(x: str, y: str, max_edits: int, columns: str | None = None) -> str:
    """SQL for the edit distance of two character arrays if it is at most ``max_edits``, else for some larger number.

    In column j (of y), bit k stands for row j - max_edits + k (of x). ``d`` is the distance
    along the band's lower edge until that meets the last row, and along that row from then
    on. With ``columns`` only that many are run, and the result is no distance, but still
    larger than ``hopeless_from`` where the arrays aren't within ``max_edits``, if that shows.
    """
    t = max_edits
    width = 2 * t + 1
    mask = (1 << width) - 1
    match = " + ".join(f"if(j - {t} + {k} >= 1 and get({x}, j - {t} + {k} - 1) <=> get({y}, j - 1) and j - {t} + {k} <= size({x}), {1 << k}L, 0L)" for k in range(width))
    zero = "((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn)"
    row = f"(size({x}) - j + {t})"
    step = f"""transform(transform(transform(array({match}), m -> named_struct('m', m, 'z', {zero} & {mask}L)),
        q -> named_struct('z', q.z, 'hp', (s.vn | ~(q.z | s.vp)) & {mask}L, 'hn', q.z & s.vp)),
        q -> named_struct(
            'vp', (q.hn | ~(shiftright(q.z, 1) | q.hp)) & {mask}L,
            'vn', shiftright(q.z, 1) & q.hp,
            'd', s.d + if(j + {t} <= size({x}), if(q.z & {1 << (width - 1)}L = 0, 1, 0),
                cast(shiftright(q.hp, {row}) & 1 as int) - cast(shiftright(q.hn, {row}) & 1 as int))))[0]"""
    start = f"named_struct('vp', {mask ^ ((1 << t) - 1)}L, 'vn', 0L, 'd', least(size({x}), {t}))"
    upto = f"size({y})" if columns is None else f"least(size({y}), {columns})"
    return (
        f"case when abs(size({x}) - size({y})) > {t} then {hopeless_from(x, y, t)} + 1 when size({x}) = 0 or size({y}) = 0 then greatest(size({x}), size({y})) "
        f"else aggregate(sequence(1, {upto}), {start}, (s, j) -> if(s.d > {hopeless_from(x, y, t)}, s, {step}), s -> s.d) end"
    )


def hopeless_from(x: str, y: str, max_edits: int) -> str:
    """SQL for the number above which ``d`` can't come back under ``max_edits``."""
    return f"({2 * max_edits} + abs(size({x}) - size({y})))"


def within(a: str, b: str, max_edits: int, min_chars: int = 0) -> str:
    """SQL that holds where lines are within ``max_edits``, or what is allowed to those of under ``min_chars``.

    Common ends are stripped; transforms of one element name what stands more than once below.
    """
    most = f"least(char_length({a}), char_length({b}))"

    def middle(c: str) -> str:
        rest = f"char_length({c}) - f - g"
        return f"if({rest} = 0, cast(array() as array<string>), split(substring({c}, f + 1, {rest}), ''))"

    early = f"{banded_distance('e.x', 'e.y', max_edits, str(FIRST_COLUMNS))} <= {hopeless_from('e.x', 'e.y', max_edits)}"
    whole = f"{banded_distance('e.x', 'e.y', max_edits)} <= {allowed(a, b, max_edits, min_chars)}"
    near = f"transform(array(named_struct('x', {middle(a)}, 'y', {middle(b)})), e -> {early} and {whole})[0]"
    return f"transform(array({common_prefix(a, b, most)}), f -> transform(array({common_suffix(a, b, f'{most} - f')}), g -> {near})[0])[0]"


def verified(pairs: DataFrame, max_edits: int, min_chars: int = 0) -> DataFrame:
    """The rows of ``pairs`` (with line_a, line_b) whose lines are near."""
    return pairs.where(within("line_a", "line_b", max_edits, min_chars))


def line_links(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``a, b``: the MD5 digests of different lines that are near; they connect whatever all such pairs connect."""
    if not 0 <= max_edits < min_chars:
        raise ValueError("lines that can be near need more characters than edits")
    long_ = occurrences(docs).where(F.char_length("line") >= min(SHORT_CHARS, min_chars))
    hashed = long_.select(F.xxhash64("line").alias("h"), F.struct(F.unhex(F.md5("line")).alias("id"), F.col("line")).alias("x"))
    # Two lines with one 64-bit hash both stay.
    distinct = hashed.groupBy("h").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    distinct = distinct.select("h", F.explode(F.expr("if(low.id = high.id, array(low), array(low, high))")).alias("x")).select("h", "x.id", "x.line", F.char_length("x.line").alias("n"))
    # Bucketed by the hash as the shuffle left it, so that lines are looked up without moving them again.
    name = f"archgraph_lines_{uuid.uuid4().hex}"
    distinct.write.bucketBy(ranges_of(docs), "h").option("path", shared_path(docs.sparkSession, "lines")).option("compression", "zstd").saveAsTable(name)
    try:
        return _links_of(docs.sparkSession.table(name), max_edits, min_chars)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay, as those of any table in the shared folder


def _texts(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """``h, id, line, bag`` of the lines with a hash ``h`` in ``asked``, in one look at all."""
    # Buckets are as many as the table's size asks for, and a task's hash table holds the hashes of one.
    return asked.distinct().hint("shuffle_hash").join(lines, "h").select("h", "id", "line", F.expr(letter_bag("line")).alias("bag"))


def _near(pairs: DataFrame, texts: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """The pairs (ha, hb) that are near, with their lines' digests a and b."""
    a, b = (texts.selectExpr(f"h as h{x}", f"id as {x}", f"line as line_{x}", f"bag as bag_{x}") for x in "ab")
    like = pairs.join(a, "ha").join(b, "hb").where(bags_near("bag_a", "bag_b", max_edits))
    return verified(like, max_edits, min_chars).select("ha", "hb", "a", "b")


def _filed(keyed: DataFrame) -> DataFrame:
    """How many lines are filed under a key, and the one with the smallest hash."""
    return keyed.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("n"))


def _tied(stars: list[DataFrame], rows: int) -> DataFrame:
    """``tied, leader``: of each line that is tied to others, the smallest of them.

    A leader tied to a smaller one keeps that tie: it and its members then differ in their
    leader, which costs a pair that meets again, and loses none.
    """
    every = stars[0]
    for more in stars[1:]:
        every = every.union(more)
    return _table(every.groupBy("ha").agg(F.min("hb").alias("leader")).withColumnRenamed("ha", "tied"), "tied", rows)


def _table(frame: DataFrame, label: str, rows: int) -> DataFrame:
    """A table of what a few keys of each of so many rows give: a task, and a file, for some thousand rows, however many there are."""
    return materialize(in_few_files(frame, rows), label)


def _led(rows: DataFrame, tied: DataFrame, h: str, leader: str) -> DataFrame:
    """With the leader of ``h``, which is the line itself for most."""
    return rows.join(tied, F.col(h) == F.col("tied"), "left").withColumn(leader, F.coalesce("leader", h)).select(*rows.columns, leader)


def _links_of(lines: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    n_lines = lines.count()
    filed = _table(_filed(_keys(lines, max_edits, min_chars, all_=False)), "filed-keys", n_lines)
    # Each key is met by at most one row there, so this join gives no more rows than lines have
    # keys, and few: of a key with one filed line those of other lines, and all of the others.
    hits = _keys(lines, max_edits, min_chars).join(filed, "key").where("n > 1 or h <> least")
    hits = _table(hits.select("key", "n", "h", "least", "filed"), "hits", n_lines)
    # The lines that any step below compares, in one look at all.
    texts = _table(_texts(lines, hits.select("h").union(hits.select("least"))), "texts", n_lines)
    search = _Search(texts, max_edits, min_chars)
    search.compare(search.meet(hits, n_lines), n_lines)
    return search.links()


class _Search:
    """What has been found: ``stars``, of lines to the smallest of a key, and ``near``, other links."""

    def __init__(self, texts: DataFrame, max_edits: int, min_chars: int) -> None:
        self.texts, self.max_edits, self.min_chars = texts, max_edits, min_chars
        self.stars: list[DataFrame] = []
        self.near: list[DataFrame] = []

    def _near(self, pairs: DataFrame) -> DataFrame:
        return _near(pairs.distinct(), self.texts, self.max_edits, self.min_chars)

    def _add(self, pairs: DataFrame) -> None:
        """Each step's links are a table, so that no plan holds more than one step."""
        self.near.append(materialize(self._near(pairs), "links"))

    def meet(self, hits: DataFrame, n_rows: int) -> DataFrame:
        """Tie the lines filed under a key to its smallest, and compare those that meet one line only.

        Returns the rows under keys with several filed lines, with their leaders.
        """
        ties = hits.where("n > 1 and filed and h <> least").selectExpr("h as ha", "least as hb")
        self.stars.append(materialize(self._near(ties), "stars"))
        tied = _tied(self.stars, n_rows)
        single = hits.where("n = 1").selectExpr("least(h, least) as ha", "greatest(h, least) as hb").distinct()
        self._add(_led(_led(single, tied, "ha", "la"), tied, "hb", "lb").where("la <> lb").select("ha", "hb"))
        return _table(_led(hits.where("n > 1").drop("n", "least"), tied, "h", "led_by").withColumnRenamed("led_by", "leader"), "shared-rows", n_rows)

    def compare(self, rows: DataFrame, n_rows: int) -> None:
        """Compare the lines under keys with several filed lines that differ in their leader."""
        by_leader = rows.groupBy("key", "leader").agg(F.count("*").alias("m"), F.count_if("filed").alias("f"))
        keys = by_leader.groupBy("key").agg(F.sum("m").alias("m"), F.max_by("leader", F.struct("m", "leader")).alias("most"), F.max("m").alias("top"), F.sum("f").alias("f"))
        # Lines of one leader never need to meet.
        keys = keys.where("m > top and f > 0").selectExpr("key", "m", "m as weight", "most", f"m - top > {BOUND} as hot")
        known = look_up(rows, _table(keys, "described", n_rows), ["key"], "weight", rows.count()).where("hot is not null")
        known = _table(known, "described", n_rows)
        salts = f"cast(ceil(m / {PART}) as int)"
        cool = known.where("not hot")
        one = cool.where("leader <> most").selectExpr("key", f"explode(sequence(0, {salts} - 1)) as salt", "h as h1", "leader as l1", "filed as f1")
        other = cool.selectExpr("key", f"cast(pmod(h, {salts}) as int) as salt", "h as h2", "leader as l2", "filed as f2")
        pairs = one.hint("merge").join(other, ["key", "salt"]).where("(f1 or f2) and l1 <> l2")
        self._add(pairs.selectExpr("least(h1, h2) as ha", "greatest(h1, h2) as hb"))
        self._compare_by_letters(known.where("hot").selectExpr("key", "h", "leader", "leader <> most as rare", "filed"))

    def _compare_by_letters(self, rows: DataFrame) -> None:
        """Compare the lines under a key that agree on two parts of their letters' bits.

        What compares them is the join's own condition, so that pairs which are many and not near are
        neither written nor moved.
        """
        near = within("line_a", "line_b", self.max_edits, self.min_chars)
        self.near.append(materialize(self._letter_pairs(rows).where(near).selectExpr("id_a as a", "id_b as b"), "links"))

    def _letter_pairs(self, rows: DataFrame) -> DataFrame:
        """The pairs whose letters are near, each under the first part that it agrees on, or the first two where that one is frequent.

        A line is filed by one part at a time, and by a second one only where many others agree on the first.
        """
        masks = _parts(self.max_edits)
        parts = [f"named_struct('part', {k}, 'mask', {m}L)" for k, m in enumerate(masks)]
        filed = rows.join(self.texts.select("h", "bag"), "h").selectExpr("*", f"inline(array({', '.join(parts[:-1])}))")
        first = self._grouped(filed.selectExpr("xxhash64(key, part, bag & mask) as sub", "part as x", "h", "bag", "leader", "rare", "filed"))
        frequent = first.where(f"r > {DIRECT}").selectExpr("*", f"inline(slice(array({', '.join(parts[1:])}), x + 1, {len(masks)}))")
        second = self._grouped(frequent.selectExpr("xxhash64(sub, part, bag & mask) as sub", "x", "part as y", "h", "bag", "leader", "rare", "filed"))
        # A pair meets only there where of the parts up to the last one filed by it agrees on those filed by.
        found = first.where(f"r <= {DIRECT}").selectExpr("sub", "h", "leader", "rare", "filed", "m", "shiftleft(1, x) as agree", "shiftleft(2, x) - 1 as of")
        found = found.union(second.selectExpr("sub", "h", "leader", "rare", "filed", "m", "shiftleft(1, x) | shiftleft(1, y)", "shiftleft(2, y) - 1"))
        found = materialize(found.join(self.texts, "h").selectExpr("*", f"cast(ceil(m / {PART}) as int) as salts"), "described")
        a, b = (tuple(f"{c} as {c}_{k}" for c in ("h", "id", "line", "bag", "leader", "rare", "filed")) for k in "ab")
        one = found.where("rare").selectExpr("sub", "agree", "of", "explode(sequence(0, salts - 1)) as salt", *a)
        other = found.selectExpr("sub", "cast(pmod(h, salts) as int) as salt", *b)
        # Two rare lines meet twice.
        once = "(filed_a or filed_b) and leader_a <> leader_b and (not rare_b or h_a < h_b)"
        agreed = " | ".join(f"if((bag_a ^ bag_b) & {m}L = 0L, {1 << k}, 0)" for k, m in enumerate(masks))
        return one.hint("merge").join(other, ["sub", "salt"]).where(f"{bags_near('bag_a', 'bag_b', self.max_edits)} and {once} and ({agreed}) & of = agree")

    def _grouped(self, filed: DataFrame) -> DataFrame:
        """The rows under a ``sub`` with a pair that has to meet, with how many rows ``m`` and rare lines ``r`` are there."""
        filed = materialize(filed, "described")
        n_filed = filed.count()
        groups = filed.groupBy("sub").agg(F.count("*").alias("weight"), F.count_if("rare").alias("r"), F.count_if("filed").alias("f"), F.min("leader").alias("low"), F.max("leader").alias("high"))
        groups = _table(groups.where("r > 0 and f > 0 and low < high").selectExpr("sub", "weight", "weight as m", "r"), "described", n_filed)
        return _table(look_up(filed, groups, ["sub"], "weight", n_filed).where("m is not null"), "described", n_filed)

    def links(self) -> DataFrame:
        """``a, b`` of all links."""
        out = self.stars[0].select("a", "b")
        for more in [*self.stars[1:], *self.near]:
            out = out.union(more.select("a", "b"))
        return out


def _parts(max_edits: int) -> list[int]:
    """Masks, as signed longs, of parts of the bits of letter counts: so many that near lines, which differ in few bits, agree on two.

    Counts are dealt out in turn, so that frequent letters are in different parts.
    """
    n = 2 * max_edits + 2
    bits = (sum(3 << 2 * c for c in range(k, 32, n)) for k in range(n))
    return [x - (1 << 64) if x >> 63 else x for x in bits]


def removed_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, version, line_no, exact`` of each line that an earlier one of its class makes needless.

    ``exact`` is whether the line equals the one that stays.
    """
    links = line_links(docs, max_edits, min_chars)
    roots = connected_components(links).withColumnRenamed("node", "id")
    found = materialize(occurrences(docs).select("doc_id", "version", "line_no", F.unhex(F.md5("line")).alias("id")).distinct(), "occurrences")
    # Copies are counted before classes are looked at, so that a common line is one row there.
    place = F.struct("doc_id", "version", "line_no")
    each = materialize(found.groupBy("id").agg(F.count("*").alias("n"), F.min(place).alias("first")), "lines-once")
    linked = each.join(roots, "id")
    class_ = linked.groupBy("root").agg(F.min(F.struct("first", "id")).alias("x"))
    stays = linked.select("id", "root").join(class_, "root").selectExpr("id", "x.first as first", "id = x.id as exact")
    stays = stays.union(each.join(roots, "id", "left_anti").where("n > 1").selectExpr("id", "first", "true as exact"))
    later = found.join(stays, "id").where("not (doc_id <=> first.doc_id and version = first.version and line_no = first.line_no)")
    return later.select("doc_id", "version", "line_no", "exact")


def deduplicate_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, version, n_lines, n_exact, n_near, n_kept, removed`` for each row of ``docs``.

    ``version`` is the text's XXH64, which tells the texts of one doc_id apart. ``removed``
    lists the numbers (from 0) of the lines that go, in order.
    """
    removed = removed_lines(docs, max_edits, min_chars)
    gone = removed.groupBy(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).agg(
        F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.sort_array(F.collect_list("line_no")).alias("removed")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), n_lines.cast("long").alias("n_lines"))
    return every.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left").select(
        "doc_id", "version", "n_lines",
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr("n_lines - coalesce(n_exact, 0) - coalesce(n_near, 0)").alias("n_kept"),
        F.expr("coalesce(removed, cast(array() as array<int>))").alias("removed"),
    )


def apply_removal(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``decided`` (of deduplicate_lines) removes cut from each text.

    A text's lines go by its doc_id and its own hash, so that rows with one id lose their own lines only.
    """
    key, version, gone = fresh(docs, "_id", "_version", "_removed")
    plan = decided.where(F.size("removed") > 0).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("removed").alias(gone)).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    joined = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(plan[key]) & (F.xxhash64(text) == plan[version]), "left")
    cut = F.expr(f"array_join(filter(split(text, '\n', -1), (line, i) -> not array_contains(coalesce(`{gone}`, cast(array() as array<int>)), i)), '\n')")
    return joined.select(*((F.when(F.col("text").isNotNull(), cut).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns))

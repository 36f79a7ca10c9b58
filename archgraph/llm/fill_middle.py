"""Fill-in-the-middle transformation by lookaround splitting, in SQL functions only.

A unit grammar is a rule over classes of characters, such as "a run of white space and the
word after it". What it matches from left to right is what stands between its boundaries,
and each boundary shows in the two characters beside it alone: so a grammar is translated to
a zero-width regular expression of a lookbehind and a lookahead class, at which ``split`` cuts
a text without losing a character.

1. The text is split into its n units; the empty text, of which ``split`` would make one empty
   piece, has none.
2. SHA-256 of the seed and the document's id gives four numbers: two cut points among
   0 .. n, whether the document is changed, and in which of the two orders.
3. The pieces before, between and after the cuts are put behind their sentinels. A text that
   holds a sentinel stays plain, so that each changed text is read back exactly.

One map over the documents; no shuffle.

Defined cases: a null text is empty; an empty text has no units and stays plain; a null
doc_id is drawn as the empty string; rows that repeat are drawn alike, as the draw depends on the id only; rows
with one id and different texts share their draw; very long texts are cut whole, in one array of their units; other columns pass
through ``fill_in_middle`` under their names, and no further; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column, fresh

#: The white space of the contract's words.
SPACE = r"\x20\x09-\x0D"
PSM, SPM, PLAIN = "psm", "spm", "plain"


@dataclass(frozen=True)
class Boundary:
    """A unit ends where a character of the class ``behind`` stands before one of the class ``ahead``.

    Classes are the insides of regular-expression brackets; an empty one admits any character.
    """

    behind: str
    ahead: str

    def regex(self) -> str:
        behind = f"(?<=[{self.behind}])" if self.behind else r"(?<=[\s\S])"
        ahead = f"(?=[{self.ahead}])" if self.ahead else r"(?=[\s\S])"
        return behind + ahead


#: Unit grammars and their boundaries.
UNITS = {
    # [space]*[^space]+ | [space]+ : a unit ends before white space that follows a word.
    "token": Boundary(f"^{SPACE}", SPACE),
    # [^space]+[space]* | [space]+ : white space belongs to the word before it.
    "word": Boundary(SPACE, f"^{SPACE}"),
    # [^\n]*\n | [^\n]+ : a line with its line feed.
    "line": Boundary(r"\n", ""),
}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def regex(self) -> str:
        return "|".join("\\Q" + x + "\\E" for x in self.all())


def units(text: Column, unit: str = "token") -> Column:
    """The units of a text, in order; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS[unit].regex(), -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, sentinels.regex(), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(
    docs: DataFrame, unit: str = "token", rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: Sentinels = Sentinels()
) -> DataFrame:
    """``docs`` with ``fim``: n, form, prefix, middle, suffix and output of each text.

    ``rate`` percent of the documents are changed, and of those ``spm_rate`` percent put their
    suffix first. ``prefix``, ``middle`` and ``suffix`` are null where the text stays plain. A column of
    ``docs`` named fim, in any case, keeps its name, and the new one gets underscores in front.
    """
    text_, pieces, n, low, high, form, changed, before, between, after, fim = fresh(docs, "_text", "_pieces", "_n", "_low", "_high", "_form", "_changed", "_prefix", "_middle", "_suffix", "fim")
    kept = [column(docs, c) for c in docs.columns]
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    at = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text_))
    at = at.select("*", units(F.col(text_), unit).alias(pieces)).select("*", F.size(pieces).cast("long").alias(n))
    cuts = (h1 % (F.col(n) + 1), h2 % (F.col(n) + 1))
    plain = (F.col(text_) == "") | (h3 % 100 >= rate)
    for x in sentinels.all():
        plain = plain | F.contains(F.col(text_), F.lit(x))
    at = at.select("*", F.least(*cuts).cast("int").alias(low), F.greatest(*cuts).cast("int").alias(high), F.when(plain, PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM).alias(form))
    at = at.select("*", (F.col(form) != PLAIN).alias(changed))

    def cut(start: Column, length: Column) -> Column:
        return F.when(F.col(changed), F.array_join(F.slice(pieces, start, length), ""))

    at = at.select(
        "*", cut(F.lit(1), F.col(low)).alias(before), cut(F.col(low) + 1, F.col(high) - F.col(low)).alias(between),
        cut(F.col(high) + 1, F.col(n).cast("int") - F.col(high)).alias(after),
    )
    p, s, m = (F.lit(x) for x in sentinels.all())
    output = (
        F.when(F.col(form) == PSM, F.concat(p, before, s, after, m, between))
        .when(F.col(form) == SPM, F.concat(s, after, p, before, m, between)).otherwise(F.col(text_))
    )
    made = F.struct(F.col(n).alias("n"), F.col(form).alias("form"), F.col(before).alias("prefix"), F.col(between).alias("middle"), F.col(after).alias("suffix"), output.alias("output"))
    return at.select(*(F.col(f"`{c}`") for c in docs.columns), made.alias(fim))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for each row of ``docs``."""
    made = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    return r"""
        with t as (
            select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (
            select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as x,
                cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
            from t),
        c as (
            select *, cast(len(x) as bigint) as n, least(h1 % (len(x) + 1), h2 % (len(x) + 1)) as a, greatest(h1 % (len(x) + 1), h2 % (len(x) + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                    when h4 % 100 < 80 then 'spm' else 'psm' end as form
            from u),
        p as (
            select *, case when form <> 'plain' then array_to_string(x[1:a], '') end as prefix, case when form <> 'plain' then array_to_string(x[a + 1:b], '') end as middle,
                case when form <> 'plain' then array_to_string(x[b + 1:], '') end as suffix
            from c)
        select doc_id, n, form, cast(length(prefix) as bigint) as prefix_chars, cast(length(middle) as bigint) as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(text) as restored_sha256
        from p"""

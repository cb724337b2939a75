"""Quality rules, line first (native).

Every line is judged by rules for punctuation, navigation and boilerplate. Failing
lines are removed, and a document that loses too much of its text this way, or that
fails the base rules on length and repetition, is rejected. All of it is one
projection over the documents: no shuffle, no Python.

Defined results: a NULL, empty or blank text has no words, counts zero everywhere and
is rejected (too short). Rows are judged one by one, so repeated ids or rows are fine.
Lines without a word are neither judged nor counted. Other columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import BLANKS, once, words

SYMBOLS = "#*$%&|<>"

# Openings of lines that carry terms or calls to act instead of text.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "©", "licensed under",
    "spdx-license-identifier", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "we use cookies", "this site uses cookies", "click here",
    "subscribe to", "sign up for", "share this", "follow us", "read more",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum",
    "wir verwenden cookies", "diese website verwendet cookies", "hier klicken", "klicken sie hier",
    "newsletter abonnieren", "jetzt anmelden", "teilen auf", "folgen sie uns", "weiterlesen", "mehr lesen",
    "tous droits réservés", "conditions générales", "politique de confidentialité", "mentions légales",
    "nous utilisons des cookies", "ce site utilise des cookies", "cliquez ici", "abonnez-vous",
    "inscrivez-vous", "partager cet article", "suivez-nous", "lire la suite",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal",
    "usamos cookies", "este sitio utiliza cookies", "haga clic aquí", "haz clic aquí",
    "suscríbete", "regístrate", "compartir en", "síguenos", "leer más", "seguir leyendo",
)


@dataclass(frozen=True)
class Rules:
    """Limits. Percentages of symbols and marks refer to the characters in words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_symbol_percent: int = 10
    max_exclaim_percent: int = 8
    min_bars: int = 2
    words_per_bar: int = 6
    max_lost_percent: int = 30


BLANK = "[\\x20\\x09-\\x0D]"
OPENING = "(?:" + "|".join(x.replace("(", "\\(").replace(")", "\\)") for x in BOILERPLATE) + ")"
#: what a line that breaks a rule holds in any case
SUSPECT = f"[{SYMBOLS}!]|^{BLANK}*(?iu:{OPENING})"


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK + "+", ""))


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Whether a line breaks a rule; blank lines break none. Counts are only taken of a
    line that holds a mark or an opening that some rule asks for."""
    chars = _word_chars(line)
    bars = _count(line, "|")
    boilerplate = F.lower(F.btrim(line, F.lit(BLANKS))).rlike("^" + OPENING)
    punctuation = ((_count(line, SYMBOLS) * 100 > chars * rules.max_symbol_percent)
                   | (_count(line, "!") * 100 > chars * rules.max_exclaim_percent))
    spaces = _count(line, " ") + 1
    navigation = (bars >= rules.min_bars) & (bars * rules.words_per_bar >= spaces)
    return line.rlike(SUSPECT) & (chars > 0) & (punctuation | navigation | boilerplate)


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``documents``: ``row`` (all its columns), the counts, the
    verdict and ``clean_text`` without failing lines."""
    w = rules.window
    d = documents.select(F.struct("*").alias("row"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumns({"w": words(F.col("t")), "lines": F.split("t", "\n")})
    d = d.withColumn("wins", F.when(
        F.size("w") >= w,
        F.transform(F.sequence(F.lit(1), F.size("w") - (w - 1)),
                    lambda i: F.xxhash64(F.slice("w", i, w))),
    ).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("pairs", F.when(
        F.size(F.array_distinct("wins")) < F.size("wins"),
        F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))

    def beside(k: Column, p: Column, step: int) -> Column:
        return F.coalesce(F.get(F.col("pairs"), k + step)["h"] == p["h"], F.lit(False))

    d = d.withColumn("starts", F.sort_array(F.transform(
        F.filter("pairs", lambda p, k: beside(k, p, -1) | beside(k, p, 1)), lambda p: p["i"])))
    d = d.withColumn("n_repeat_words", F.aggregate(
        F.transform("starts", lambda p, k: F.least(
            F.lit(w), F.coalesce(F.get(F.col("starts"), k + 1) - p, F.lit(w)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x))
    d = d.withColumn("with_word", F.filter("lines", lambda x: x.rlike(f"(?!{BLANK})(?s:.)")))
    d = d.withColumn("clean", F.filter("lines", lambda x: ~line_fails(x, rules)))
    d = d.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("with_word") - F.size(F.array_distinct("with_word"))).cast("bigint")
        .alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("lines") - F.size("clean")).cast("bigint").alias("n_failed_lines"),
        F.array_join("clean", "\n").alias("clean_text"))
    d = d.withColumn("base_failed", (F.col("n_words") < rules.min_words)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent))
    lost = F.when(F.col("n_failed_lines") == 0, 0).otherwise(
        F.col("word_chars") - _word_chars(F.col("clean_text")))
    return d.withColumn("kept", ~F.col("base_failed")
                        & (lost * 100 <= F.col("word_chars") * rules.max_lost_percent))


def clean(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failing lines, in their own columns;
    ``n_chars`` follows the text."""
    judged = judge(documents, id_col, text_col, rules)
    kept = judged.withColumn("kept", once(F.col("kept"))).filter("kept")
    fresh = {text_col: F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return kept.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from riskmart.llm.common import table

    return judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_failed_lines")


def _oracle(rules: Rules = Rules()) -> str:
    starts = " or ".join(f"starts_with(s, '{x}')" for x in BOILERPLATE)
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from d),
win as (select doc_id, i, array_to_string(w[i:i+{rules.window - 1}], ' ') as s
        from (select doc_id, w, unnest(generate_series(1, len(w) - {rules.window - 1})) as i from w
              where len(w) >= {rules.window})),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
cov as (select doc_id, sum(least({rules.window}, coalesce(nxt - i, {rules.window}))) as n
        from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep)
        group by doc_id),
l as (select doc_id, x, length(translate(x, {blank}, '')) as c,
             lower(trim(x, {blank})) as s,
             length(x) - length(translate(x, '{SYMBOLS}', '')) as sym,
             length(x) - length(replace(x, '!', '')) as ex,
             length(x) - length(replace(x, '|', '')) as bars,
             length(x) - length(replace(x, ' ', '')) + 1 as sp
      from (select doc_id, unnest(string_split(t, chr(10))) as x from d)),
j as (select *, c > 0 and (sym * 100 > c * {rules.max_symbol_percent}
                or ex * 100 > c * {rules.max_exclaim_percent}
                or (bars >= {rules.min_bars} and bars * {rules.words_per_bar} >= sp)
                or {starts}) as bad from l),
ls as (select doc_id, count(*) filter (where c > 0) - count(distinct x) filter (where c > 0) as dup,
              count(*) filter (where bad) as failed, coalesce(sum(c) filter (where bad), 0) as lost
       from j group by doc_id),
b as (select w.doc_id, cast(len(w) as bigint) as n_words,
             cast(length(translate(t, {blank}, '')) as bigint) as word_chars,
             cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
             cast(coalesce(dup, 0) as bigint) as n_dup_lines,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
             cast(failed as bigint) as n_failed_lines, lost
      from w left join cov using (doc_id) left join ls using (doc_id)),
v as (select *, n_words < {rules.min_words}
                or n_repeat_words * 100 > n_words * {rules.max_repeat_percent} as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost * 100 <= word_chars * {rules.max_lost_percent} as kept,
       n_failed_lines
from v"""


ORACLE = _oracle()

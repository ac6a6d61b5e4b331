"""Operator 1, quality rules: line-first cleaning.

Every line of a text is judged by punctuation rules (doubled marks, shouting, symbols
in words), navigation rules (bars of separators, menus of short lines that end no
sentence) and boilerplate rules (phrases of four languages, words that repeat in a row).
Lines that fail are removed, then documents that lose too much of their text,
or that fail the base rules on length and repetition, are rejected. Everything
is one projection of built-in functions: no shuffle and no Python.

Defined results: a null or empty text has no words, fails the base rules and is
rejected; a null doc_id is carried along; repeated rows are judged one by one;
other columns pass through ``clean`` unless their name is one of OUTPUT, which
then replaced (so are _lines, _good, _bars and _repeats); an empty table gives an
empty result. Ties do not arise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let, one_space, read, solid_length, words_of

OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept", "clean_text")

#: Whole phrases that say nothing of a text's own, in the languages of the corpus: a short line that begins with one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "this work is licensed", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "this site uses cookies", "accept cookies", "accept all cookies", "please enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for our newsletter", "log in or sign up", "sign in to continue", "click here", "read more", "share this",
    "skip to content", "back to top", "powered by", "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine geschäftsbedingungen",
    "datenschutzerklärung", "wir verwenden cookies", "diese website verwendet cookies", "cookies akzeptieren", "bitte aktivieren sie javascript",
    "newsletter abonnieren", "hier klicken", "weiterlesen", "mehr lesen", "nach oben", "lizenziert unter", "tous droits réservés", "conditions d'utilisation",
    "mentions légales", "politique de confidentialité", "nous utilisons des cookies", "ce site utilise des cookies", "accepter les cookies",
    "veuillez activer javascript", "abonnez-vous", "cliquez ici", "lire la suite", "en savoir plus", "haut de page", "sous licence",
    "todos los derechos reservados", "condiciones de uso", "términos de uso", "política de privacidad", "usamos cookies", "utilizamos cookies",
    "este sitio utiliza cookies", "aceptar cookies", "active javascript", "suscríbete", "haga clic aquí", "haz clic aquí", "leer más", "volver arriba",
    "bajo licencia",
)
#: Marks that end a sentence or a quotation, after which a line is not a fragment.
ENDS = ".!?…:;,\"'”’»)]。！？"


#: A word of one to three of these parts the entries of a bar.
SEPARATORS = "|/\\•·›»~–—*+=<>-"


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of the words of a line or of a text."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails if more of its words than this hold a symbol of `#*$%&|<>`: navigation bars and markup.
    max_symbol_share: float = 0.2
    #: A line fails if more of its words than this end in a doubled mark such as !! or ??.
    max_doubled_share: float = 0.2
    #: A line of at least so many words fails if it has capitals and no small letter.
    min_shout_words: int = 4
    #: A line fails if more of it than this share is one word repeated so many times in a row or more.
    max_run: int = 5
    max_run_share: float = 0.2
    #: A line of at most so many words fails if it begins with a phrase of BOILERPLATE or a mark of copyright with a year or sign.
    max_boilerplate_words: int = 15
    #: Lines of at most so many words without a mark of ENDS fail if so many follow one another: menus and lists of links.
    max_menu_words: int = 4
    min_menu_lines: int = 4
    #: A line fails if more of its words than this are nothing but a separator such as |, / or a bullet.
    max_separator_share: float = 0.2
    #: A document goes if lines with more of its word characters than this share fail.
    max_lost_share: float = 0.5


def line_fails(line: Column, n: Column, symbols: Column, repeats: Column, bars: Column, rules: LineRules) -> Column:
    """Whether a line of n words fails a punctuation, navigation or boilerplate rule.

    symbols and repeats are the whole text's counts, bars says whether it has a character of SEPARATORS: without any, the rules on them need no look at the line.
    """
    symbol_words = F.regexp_count(line, F.lit(r"[#*$%&|<>][^\x20\x09-\x0D]*"))
    marked = line.contains("!!") | line.contains("??") | line.contains("!?")
    doubled = F.regexp_count(line, F.lit(r"(?:!!|\?\?|!\?)(?=[\x20\x09-\x0D]|$)"))
    # of a fixed number of words: a pattern for runs of any length takes a frame of the stack for each word, and long runs end the executor
    run = r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?=[\x20\x09-\x0D]|$)){%d}" % (rules.max_run - 1)
    separators = F.regexp_count(line, F.lit(r"(?:^|[\x20\x09-\x0D])[" + re.escape(SEPARATORS) + r"]{1,3}(?=[\x20\x09-\x0D]|$)"))
    phrases = r"^[^\p{L}\p{N}©(]{0,3}(?:(?:" + "|".join(BOILERPLATE) + r")(?![\p{L}\p{N}])|(?:copyright\s+)?(?:©|\(c\))|copyright\s+\d{4})"
    return (
        ((symbols > 0) & (symbol_words > rules.max_symbol_share * n))
        | (marked & (doubled > rules.max_doubled_share * n))
        | (bars & (separators > rules.max_separator_share * n))
        | ((n >= rules.min_shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
        | ((repeats > 0) & line.rlike(run) & (F.length(line) - run_length(line, rules.max_run) < (1 - rules.max_run_share) * F.length(line)))
        | ((n <= rules.max_boilerplate_words) & F.lower(F.substring(line, 1, 80)).rlike(phrases))
    )


def run_length(line: Column, least: int) -> Column:
    """How many characters of a line lie in runs of so many equal words or more, with the space between them and one character before each run."""
    parts = F.regexp_extract_all(line, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    worded = F.transform(parts, lambda x: F.struct(F.regexp_replace(x, r"^[\x20\x09-\x0D]+", "").alias("word"), F.length(x).alias("all")))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("held"))
    over = lambda s: s["held"] + F.when(s["n"] >= least, s["chars"]).otherwise(F.lit(0))

    def step(s: Column, x: Column) -> Column:
        same, own = s["word"] == x["word"], F.length(x["word"])
        return F.struct(
            x["word"].alias("word"), F.when(same, s["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(same, s["chars"] + x["all"]).otherwise(F.least(x["all"], own + 1)).alias("chars"), F.when(same, s["held"]).otherwise(over(s)).alias("held"),
        )

    return F.aggregate(worded, start, step, over)


def in_menu(lines: Column, i: Column, rules: LineRules) -> Column:
    """Whether line i stands in a run of short lines that end no sentence."""
    fragment = lambda j: F.coalesce(F.get(lines, j)["fragment"], F.lit(False))
    k = rules.min_menu_lines
    runs = [reduce(and_, [fragment(i + j) for j in range(first, first + k)]) for first in range(1 - k, 1)]
    return F.get(lines, i)["fragment"] & reduce(or_, runs)


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that is found twice or more (the first included)."""
    last = F.size(words) - 3
    window = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def starts(s: Column) -> Column:
        # in the order of their hashes, equal windows are neighbours; of equal hashes, words decide
        def same(a: Column, b: Column) -> Column:
            x, y = F.get(s, a), F.get(s, b)
            return F.coalesce((x["h"] == y["h"]) & reduce(and_, [p == q for p, q in zip(window(x["i"]), window(y["i"]), strict=True)]), F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(at, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        # window starts in order: each covers three words, less what the next start covers as well
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))

    def counted(h: Column) -> Column:
        # windows with different hashes differ, so a text without equal hashes has no repeats and needs no sort
        numbered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), let(let(numbered, starts), covered)).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*window(i)))
    return F.when(last < 0, F.lit(0)).otherwise(let(hashes, counted))


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with the columns of OUTPUT: the counts, the verdict and the text without its failed lines."""
    value = F.coalesce(F.col(text), F.lit(""))

    def line(x: Column) -> Column:
        n = F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
        ended = F.translate(F.substring(F.rtrim(one_space(x)), -1, 1), ENDS, "") == ""
        return F.struct(x.alias("line"), solid_length(x).alias("chars"), n.alias("n"), ((n <= rules.max_menu_words) & ~ended).alias("fragment"))

    base = docs.drop(*OUTPUT).withColumns(
        {
            "_repeats": let(words_of(value), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))),
            "_bars": reduce(or_, [value.contains(mark) for mark in SEPARATORS]),
            "_lines": F.filter(F.transform(F.split(value, "\n", -1), line), lambda x: x["n"] > 0),
            "n_symbols": (F.length(value) - F.length(F.regexp_replace(value, r"[#*$%&|<>]+", ""))).cast("long"),
        }
    )
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    judged = base.withColumns(
        {
            "n_words": F.col("_repeats.n"),
            "word_chars": chars(F.col("_lines")),
            "n_dup_lines": let(F.transform("_lines", lambda x: x["line"]), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
            "n_repeat_words": F.col("_repeats.r"),
            "_good": F.filter("_lines", lambda x, i: ~line_fails(x["line"], x["n"], F.col("n_symbols"), F.col("_repeats.r"), F.col("_bars"), rules) & ~in_menu(F.col("_lines"), i, rules)),
        }
    ).withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    return judged.withColumns(
        {
            "lost_share": F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1.0 - chars(F.col("_good")) / F.col("word_chars")),
            "clean_text": F.array_join(F.transform("_good", lambda x: x["line"]), "\n"),
        }
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost_share)).drop("_lines", "_good", "_repeats", "_bars")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share"
    )

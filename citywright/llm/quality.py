"""Line-first cleaning of documents, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: blank, and \x09 to \x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"

#: A line passes on punctuation if a sentence ends in it, behind closing quotes or brackets too.
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]}*_]*([\x20\x09-\x0D]|$)"
#: A line is navigation if a quarter of its words or more are separators, or if it is a run of menu words in English, French, German or Spanish.
SEPARATOR_CHARS = "|»›•·"
SEPARATORS = rf"[^{SEPARATOR_CHARS}]+"
MENU_WORDS = (
    *("home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back to top", "skip to content", "share", "tweet", "print", "read more", "contact us", "about us", "sitemap"),
    *("accueil", "connexion", "se connecter", "inscription", "s['’]inscrire", "recherche", "rechercher", "suivant", "précédent", "haut de page", "aller au contenu", "partager", "imprimer", "lire la suite", "contactez-nous", "à propos", "plan du site"),
    *("startseite", "anmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "zum inhalt", "teilen", "drucken", "weiterlesen", "kontakt", "über uns", "impressum"),
    *("inicio", "menú", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "ir al contenido", "compartir", "imprimir", "leer más", "contacto", "quiénes somos", "sobre nosotros", "mapa del sitio"),
)
#: Phrases of lines that are put on every page of a site, in English, French, German and Spanish.
PHRASES = (
    *("all rights reserved", "terms of (use|service)", "privacy policy", "cookie policy", "uses cookies", "accept (all )?cookies", "enable javascript", "javascript is (disabled|required)"),
    *("click here", "subscribe to our newsletter", "follow us on", "powered by", "lorem ipsum", "page not found"),
    *("tous droits réservés", "conditions (générales )?d['’]utilisation", "politique de confidentialité", "mentions légales", "utilise des cookies", "accepter (tous )?les cookies", "activer javascript"),
    *("cliquez ici", "abonnez-vous à notre newsletter", "suivez-nous sur", "page introuvable"),
    *("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren", "javascript (ist deaktiviert|aktivieren)"),
    *("klicken sie hier", "newsletter abonnieren", "folgen sie uns auf", "seite nicht gefunden"),
    *("todos los derechos reservados", "(términos|condiciones) de uso", "política de (privacidad|cookies)", "(usa|utiliza) cookies", "aceptar (todas )?las cookies", "(active|habilite) javascript"),
    *("ha(z|ga) clic aquí", "suscr(íbete|íbase) a nuestro boletín", "s(íguenos|íganos) en", "página no encontrada"),
)
#: Every phrase has one of these in it, in lower case. Only lines that have one too are searched for phrases, which costs far more than looking for plain strings.
STEMS = (
    *("cookie", "javascript", "newsletter"),
    *("rights reserved", "terms of ", "privacy policy", "click here", "follow us on", "powered by", "lorem ipsum", "page not found"),
    *("tous droits", "utilisation", "politique de con", "mentions l", "cliquez ici", "suivez-nous", "introuvable"),
    *("rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "klicken sie", "folgen sie uns", "nicht gefunden"),
    *("derechos reservados", " de uso", "tica de ", "clic aqu", "nuestro bolet", "nos en", "no encontrada"),
)


def _any_of(patterns: tuple[str, ...]) -> str:
    """One of ``patterns``. Letters beyond ASCII are named in both cases, since regular expressions differ in whether they fold them."""
    one = "|".join(patterns)
    return "(" + "".join(f"[{c}{c.upper()}]" if c > "\x7f" and c.isalpha() else c for c in one) + ")"


MENU = rf"(?i)^\W*{_any_of(MENU_WORDS)}(\W+{_any_of(MENU_WORDS)})*\W*$"
BOILERPLATE = "(?i)" + _any_of(PHRASES)

#: Documents with fewer words, or more of them in repeated 3-word windows, fail at once.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Documents of which the kept lines hold a smaller part of the words are rejected.
LEAST_KEPT_PERCENT = 50
#: More symbols than this for 100 characters fail a line.
MOST_SYMBOLS_PERCENT = 10


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _left(text: Column, pattern: str) -> Column:
    """Characters that stay when ``pattern`` is taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _contains_any(text: Column, strings: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(s) for s in strings])


def _line_passes(line: Column, lower: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for a line that has a word; ``lower`` is the line in lower case."""
    words = F.size(F.split(F.trim(line), SPACES))
    chars = F.length(line)
    symbols_ok = 100 * _left(line, SYMBOLS) <= MOST_SYMBOLS_PERCENT * chars
    navigation = _contains_any(line, SEPARATOR_CHARS) & (4 * _left(line, SEPARATORS) >= words)
    boilerplate = _contains_any(lower, STEMS) & line.rlike(BOILERPLATE)
    return line.rlike(SENTENCE_END) & symbols_ok & ~navigation & ~line.rlike(MENU) & ~boilerplate


def _passing(lines: Column) -> Column:
    """The lines of an array that pass. Each is put in lower case once, beside itself."""
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("lower")))
    return F.transform(F.filter(both, lambda x: _line_passes(x["line"], x["lower"])), lambda x: x["line"])


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the figures of its lines and words, the cleaned text and a verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_lines_kept, n_words_kept
    (long), clean_text (the lines that pass, joined by newlines), base_failed and kept (boolean). A line
    fails if no sentence ends in it, or it is mostly symbols or separators, is a menu, or holds a boilerplate
    phrase; a line equal to an earlier one falls away too. A document is kept unless ``base_failed`` or less
    than half of its words are in lines that pass. Null text counts as empty: all figures 0, not kept. A
    column of ``docs`` with one of the added names is replaced; all other columns, whatever their names, stay as they are. Each
    row is judged alone, so repeated rows get the same verdict, and there is no shuffle.
    """
    # the caller's columns travel in one struct, beside which no name of theirs can clash with a step's
    names = [c for c in docs.columns if c.lower() not in _ADDED]
    return _judged(docs, names, text_col).select(*(["row.*"] if names else []), *_FIGURES)


def _judged(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """(row, figures): the columns ``names`` of ``docs`` as a struct, and what ``clean_lines`` adds."""
    # word hashes are kept, not words: three of them name a window, and arrays of numbers sort fast
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_"))
    base = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    cut = base.select("*", _words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    counted = cut.select(
        "row",
        "_lines",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _left(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    last = F.size("_h") - 3
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i"))))
    windowed = counted.select("*", windows.alias("_win")).select("*", F.size(F.array_distinct(F.col("_win.h"))).alias("_kinds"))
    sorted_ = windowed.select("*", F.when(F.col("_kinds") < F.size("_win"), F.sort_array("_win")).alias("_s"), _passing(F.array_distinct("_lines")).alias("_ok"))
    same = lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"])
    at = sorted_.select("*", F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])).alias("_at"))
    zero = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("_at", zero, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])
    kept_words = F.aggregate("_ok", F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, SPACES), lambda w: w != "")))
    figures = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_ok").cast("long").alias("n_lines_kept"),
        kept_words.cast("long").alias("n_words_kept"),
        F.array_join("_ok", "\n").alias("clean_text"),
    )
    # a generator of one row: a filter on the verdict is not moved below it, where it would compute the arrays anew
    out = at.select("row", F.inline(F.array(figures)))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_words_kept") >= LEAST_KEPT_PERCENT * F.col("n_words")))


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_kept", "n_words_kept", "clean_text", "base_failed", "kept"]
_ADDED = set(_FIGURES)


def keep_clean(docs: DataFrame, text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``clean_lines`` keeps, columns unchanged; with ``cleaned``, their texts hold only the lines that pass."""
    kept = _judged(docs, docs.columns, text_col).where("kept")
    if not cleaned:
        return kept.select("row.*")
    return kept.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql() -> str:
    """``clean_lines`` over ``documents``, without its texts, as DuckDB SQL."""
    left = lambda text, pattern: f"length(regexp_replace({text}, {_quoted(pattern)}, '', 'g'))"
    words = lambda text: f"list_filter(string_split_regex({text}, {_quoted(SPACES)}), lambda x: x <> '')"
    passes = " AND ".join(
        [
            f"regexp_matches(line, {_quoted(SENTENCE_END)})",
            f"100 * {left('line', SYMBOLS)} <= {MOST_SYMBOLS_PERCENT} * length(line)",
            f"4 * {left('line', SEPARATORS)} < len(string_split_regex(trim(line), {_quoted(SPACES)}))",
            f"NOT regexp_matches(line, {_quoted(MENU)})",
            f"NOT regexp_matches(line, {_quoted(BOILERPLATE)})",
        ]
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_quoted(WORD)})) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
ok AS (SELECT doc_id, count(*) AS n, sum(len({words('line')})) AS words FROM (SELECT doc_id, unnest(list_distinct(ls)) AS line FROM w) WHERE {passes} GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {left('t', SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(ok.n, 0)::BIGINT AS n_lines_kept, coalesce(ok.words, 0)::BIGINT AS n_words_kept FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ok USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AND 100 * n_words_kept >= {LEAST_KEPT_PERCENT} * n_words AS kept FROM f
"""

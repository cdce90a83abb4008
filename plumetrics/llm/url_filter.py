"""URL filter: allow and block rules, then a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# One strict term rejects alone; soft ones only together. By language: English, Spanish, French, German, Italian,
# Portuguese, Dutch, Polish, Russian, Chinese, Japanese.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "camgirl", "escorts", "warez", "keygen", "phishing", "malware",
    "onlinecasino", "sexcam", "pornstar", "milf", "blowjob", "bukkake", "gangbang", "cumshot", "upskirt", "deepnude",
    "sexchat", "freesex", "livesex", "livecam", "camsex", "serialz", "cracked-apk", "spyware", "ransomware", "carding",
    "pornografia", "putas", "follando", "pornographie", "baise", "salope", "partouze", "pornografie", "ficken", "nutten",
    "huren", "sexkontakte", "scopare", "troie", "putaria", "buceta", "neuken", "hoeren", "seksfilm", "ruchanie",
    "порно", "порнуха", "шлюхи", "色情", "成人视频", "エロ動画",
)
SOFT = (
    "adult", "bet", "betting", "casino", "crack", "dating", "escort", "erotic", "gambling", "jackpot", "nude", "nsfw",
    "payday", "pills", "poker", "sex", "sexy", "slots", "torrent", "viagra", "cialis", "blackjack", "roulette", "bookmaker",
    "lottery", "hookup", "fetish", "bdsm", "lesbian-video", "topless", "naked", "strip", "stripper", "lingerie", "swinger",
    "webcam", "hacked", "cheats", "serial", "nulled", "pirated", "replica", "steroids", "tramadol", "levitra",
    "apuestas", "tragaperras", "ruleta", "desnuda", "erótico", "erotico", "citas", "paris-sportifs", "érotique", "erotique",
    "rencontre", "nue", "jeux-argent", "wetten", "spielautomat", "erotik", "nackt", "partnersuche", "glücksspiel",
    "scommesse", "incontri", "nuda", "apostas", "caça-níqueis", "namoro", "gokken", "gokkast", "naakt", "zakłady", "kasyno",
    "randki", "казино", "ставки", "секс", "знакомства", "赌场", "博彩", "カジノ", "アダルト",
)
# Words that spam hosts run together with a term, before it or behind it.
LURES = ("best", "free", "live", "online", "top")
TAILS = ("24", "online", "tube", "video")
SOFT_LIMIT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without it."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """``value`` of the longest rule that fits host (or a parent domain of it) and path; null if none does."""
    found = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, value)))
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def forms(term: str) -> list[str]:
    """The ways a term is written: itself and, in ASCII, with a plural ending or run together with a lure or tail."""
    if not term.isascii():
        return [term]
    plural = [] if term.endswith(("s", "x", "z")) else [term + "s"]
    return [term, *plural, *(lure + term for lure in LURES), *(term + tail for tail in TAILS)]


def vocabulary(strict: Sequence[str], soft: Sequence[str]) -> dict[str, tuple[str, bool]]:
    """written form -> (term, whether it is strict); a form of several terms goes to the strict, then the first one."""
    found: dict[str, tuple[str, bool]] = {}
    for is_strict, terms in ((True, strict), (False, soft)):
        # Terms as they stand come before the forms of others.
        for form, term in [*((t, t) for t in terms), *((f, t) for t in terms for f in forms(t))]:
            found.setdefault(form.lower(), (term, is_strict))
    return found


def readable(url: str | None) -> str:
    """The url in lower case with ``%xx`` decoded once (UTF-8; other bytes become U+FFFD)."""
    return unquote(url or "").lower()


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """Pandas UDF: url -> (strict, soft) numbers of distinct terms that stand free of letters and digits."""
    terms = vocabulary(strict, soft)

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for form in terms:
            automaton.add_word(form, form)
        automaton.make_automaton()
        for urls in parts:
            rows = []
            for url in urls:
                # Padding makes both ends of the url boundaries.
                text = f" {readable(url)} "
                seen = {
                    terms[form] for end, form in (automaton.iter(text) if terms else ())
                    if not text[end + 1].isalnum() and not text[end - len(form)].isalnum()
                }
                n = sum(is_strict for _, is_strict in seen)
                rows.append((n, len(seen) - n))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits"])

    return hits


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT, page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row per page: host, path, rule, verdict, and the numbers of distinct strict and soft terms.

    A fitting rule decides; otherwise one strict term or ``soft_limit`` distinct soft terms block. Forms of one term
    (``forms``) count once, and ``%xx`` is decoded for the vocabulary, not for host and path. A null url, an
    empty one and one without ``://`` have an empty host and path and fit no rule (the vocabulary still reads what
    text there is). Repeated pages give repeated rows, an empty table an empty result; other columns are ignored.
    A rule is as long as its host and path together; rules of one length go by code point. One pass, no shuffle.
    """
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("_url"))
    split = read.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
                        vocabulary_hits(tuple(strict), tuple(soft))("_url").alias("_hits"))
    host, path = F.col("host"), F.col("path")
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return split.select("page_id", "host", "path", "_hits.*").select(
        "page_id", "host", "path", best_rule(rules, host, path, "name").alias("rule"),
        F.coalesce(best_rule(rules, host, path, "verdict"), own).alias("verdict"), "strict_hits", "soft_hits",
    )

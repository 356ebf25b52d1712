"""URL filter: allow/block rules first, then logistic regression on hashed n-grams.

``judge_urls`` splits each url into host and path, applies the longest rule
that fits, and leaves the rest to a logistic regression over hashed character
n-grams of host and path.  The model is trained here, on the driver, from a
small labelled url table that owes nothing to the tables judged: unwanted
subjects (gambling, adult, pills, tracking, piracy, fraud) and ordinary ones are
put into the same host patterns, ends and paths, beside well-known sites.
``split_labelled`` holds out a fifth of the hosts.

Edge cases: a null url, or one without ``://``, has empty host and path and is
judged by the model (which allows it); a score equal to the threshold blocks;
rules of equal length go by their text; a very long url is read whole; repeated
rows are judged alike; an empty table gives an empty result; other columns are
carried along, and columns named ``host``, ``path``, ``rule``, ``score`` or
``verdict`` are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")

#: Hashed feature space and n-gram lengths of the model.
DIMS, SIZES = 1 << 18, (3, 4, 5)

# Words for subjects of unwanted and of ordinary sites, and well-known hosts.
UNWANTED = (
    "casino poker slots roulette blackjack jackpot betting bets bookmaker gambling lottery "
    "porn xxx sex adult escort nude webcam erotic hentai milf "
    "viagra cialis pills tramadol steroid weightloss pharma "
    "ads adserver advert tracker tracking popunder clickbait banner spam linkfarm seolinks "
    "warez crack keygen torrent malware phishing spyware hacked payday loan replica forex getrich"
).split()
ORDINARY = (
    "news journal library museum university college school science research health recipe garden travel weather sport city county park history book poetry music film theatre code docs wiki forum photo archive "
    "river mountain bridge coffee kitchen baker butcher bicycle train harbour airport hotel village castle church market street school teacher student doctor nurse clinic hospital dentist lawyer court police fire council "
    "energy solar water forest farm animal horse bird fish dog cat flower tree stone glass paper print design paint craft wood metal tool machine engine motor car truck road map guide atlas globe planet star moon "
    "story letter word language grammar dictionary translate read write editor author publish press radio video camera studio dance opera concert festival award league club team score chess puzzle address essex address advice adventure advance"
).split()
KNOWN = (
    "google.com youtube.com wikipedia.org github.com bbc.co.uk theguardian.com reuters.com apnews.com cnn.com npr.org lemonde.fr spiegel.de zeit.de elpais.com amazon.com ebay.com etsy.com apple.com microsoft.com mozilla.org python.org "
    "apache.org debian.org gnu.org kernel.org linkedin.com reddit.com twitter.com facebook.com instagram.com pinterest.com medium.com wordpress.com blogspot.com tumblr.com vimeo.com spotify.com netflix.com imdb.com goodreads.com archive.org gutenberg.org "
    "nature.com sciencemag.org springer.com arxiv.org nih.gov nasa.gov noaa.gov europa.eu who.int un.org mit.edu harvard.edu stanford.edu ox.ac.uk cam.ac.uk ethz.ch tum.de inria.fr cnrs.fr uchile.cl unam.mx booking.com tripadvisor.com airbnb.com "
    "paypal.com stripe.com dropbox.com adobe.com oracle.com ibm.com intel.com nvidia.com weather.com accuweather.com espn.com fifa.com nba.com uefa.com quora.com yahoo.com bing.com duckduckgo.com cloudflare.com gitlab.com bitbucket.org"
).split()
PATTERNS = "{} {}s {}24 {}365 my{} the{} best{} top{} free{} {}online {}-online {}hub {}zone {}-world {}land {}club {}-today get-{} {}direct {}guide new-{}".split()
ENDS = "com net org info de fr es co.uk io eu".split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("", "/", "/index.html", "/about", "/en/12", "/fr/830", "/de/4711/", "/es/95.html", "/2021/05/a-day-out", "/products/list", "/news/world/article-77", "/user/anna")
UNWANTED_PATHS = ("/{}/", "/en/{}-bonus", "/go/{}.php", "/{}/top-10", "/cheap/{}", "/best-{}-2024.html")


def labelled_urls() -> list[tuple[str, str, int]]:
    """The training table: (host, path, 1 if unwanted), built from the lists above.

    Every subject goes through every pattern; prefix, end and path are dealt to
    both labels alike.  Ordinary hosts with an unwanted path are unwanted too.
    """
    deal = lambda text, options: options[crc32(text.encode()) % len(options)]
    rows = []
    pairs = [a + b for k in (1, 5, 12, 31) for a, b in zip(ORDINARY, ORDINARY[k:])]
    for name in pairs:
        rows.append((f"{deal('p' + name, PREFIXES)}{name}.{deal('e' + name, ENDS)}", deal("t" + name, PATHS), 0))
    for words, label in ((UNWANTED, 1), (ORDINARY, 0)):
        for word in words:
            for pattern in PATTERNS:
                name = pattern.format(word)
                rows.append((f"{deal('p' + name, PREFIXES)}{name}.{deal('e' + name, ENDS)}", deal("t" + name, PATHS), label))
    ordinary = [host for host, _, label in rows if not label]
    for host in KNOWN:
        rows += [(f"{prefix}{host}", deal(f"{prefix}{host}", PATHS), 0) for prefix in PREFIXES]
    for k, word in enumerate(UNWANTED):
        rows += [(deal(f"{word}{i}{k}", ordinary), path.format(word), 1) for i, path in enumerate(UNWANTED_PATHS)]
    for k, word in enumerate(ORDINARY):
        rows += [(deal(f"{word}{i}{k}", ordinary), path.format(word), 0) for i, path in enumerate(UNWANTED_PATHS)]
    return rows + [("", "", 0)] * 50


def split_labelled() -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """Rows for training, and held-out ones: a fifth of the hosts."""
    parts: tuple[list, list] = ([], [])
    for row in labelled_urls():
        parts[bool(row[0]) and crc32(f"held {row[0]}".encode()) % 5 == 0].append(row)
    return parts


def features(host: str, path: str) -> list[np.ndarray]:
    """Distinct hashed n-gram slots of the host and of the path, each in its own name space."""
    out = []
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        found = {crc32(raw[i : i + n], ord(mark)) % DIMS for n in SIZES for i in range(len(raw) - n + 1)}
        out.append(np.fromiter(found, np.int64, len(found)))
    return out


def train(rows: list[tuple[str, str, int]], steps: int = 600) -> np.ndarray:
    """Logistic regression by full-batch gradient steps; the last weight is the bias.

    N-grams are not scaled by their number, so an unknown part of a host or a
    long path takes nothing from what the rest says.
    """
    sets = [np.concatenate(features(h, p)) for h, p, _ in rows]
    y = np.array([label for *_, label in rows], float)
    flat, at = np.concatenate(sets), np.repeat(np.arange(len(rows)), [len(s) for s in sets])
    w, bias = np.zeros(DIMS), -1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(np.bincount(at, w[flat], len(rows)) + bias))) - y
        w -= np.bincount(flat, g[at], DIMS) / len(rows) + 1e-5 * w
        bias -= 0.1 * g.mean()
    return np.append(w, bias)


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """The model that judges: fitted to the training rows alone."""
    return train(split_labelled()[0])


def url_score(host: str, path: str, w: np.ndarray) -> float:
    z = w[-1] + sum(w[slots].sum() for slots in features(host, path))
    return float(1 / (1 + np.exp(-z)))


def _scorer():
    w = weights()

    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(hosts, paths):
            if key[0] is None:  # a rule has decided
                out.append(None)
                continue
            if (got := memo.get(key)) is None:
                got = memo[key] = url_score(*key, w)
            out.append(got)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(score, DoubleType())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def rule_column(host: Column, path: Column, rules: tuple[str, ...]) -> Column:
    """The longest rule that fits, as ``action rule``; null if none does.

    One ``CASE`` over the rules, longest first: fit for some hundreds of rules.
    """
    out = None
    for text in sorted(rules, key=lambda r: (-len(r.split(" ", 1)[1]), r)):
        at = text.split(" ", 1)[1]
        name, slash, rest = at.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(text)) if out is None else out.when(fits, F.lit(text))
    return F.lit(None).cast("string") if out is None else out


def judge_urls(pages: DataFrame, rules: tuple[str, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` (chance of unwanted; null where a rule decides) and ``verdict``."""
    host, path = split_url(F.col("url"))
    df = pages.drop("host", "path", "rule", "score", "verdict")
    kept = [F.col(c) for c in df.columns]
    df = df.select(*kept, host.alias("host"), path.alias("path"))
    df = df.select(*kept, "host", "path", rule_column(F.col("host"), F.col("path"), rules).alias("_verdict_rule"))
    asked = F.when(F.col("_verdict_rule").isNull(), F.col("host"))
    df = df.select(*kept, "host", "path", "_verdict_rule", _scorer()(asked, F.col("path")).alias("score"))
    return df.select(
        *kept,
        "host",
        "path",
        F.substring_index("_verdict_rule", " ", -1).alias("rule"),
        "score",
        F.coalesce(F.substring_index("_verdict_rule", " ", 1), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
    )

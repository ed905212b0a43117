"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL (host, then path). All globs are laid out side by side in
one row of bits, cut into 64-bit words; each byte of a URL moves every pattern's states at once by
Shift-And: states shift into the next bit where the byte fits, and a state in front of a wildcard
also stays where it is. Many URLs are stepped together, longest first, so none is cut short.

Globs: ``?`` one byte, ``*`` any bytes but '/', ``**`` any bytes, ``\\`` takes the next sign literally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLASH = ord("/")
# The rules (host and path beginning, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Hosts of kinds that no rule names; they decide where no rule fits.
BLOCKED = ("**casino**", "**free-bets**", "**xxx**", "**porn**", "**viagra**", "**torrent**")


def rule_globs(rule: str) -> tuple[str, ...]:
    """host/path: the host itself and its subdomains, with paths that begin so."""
    safe = "".join("\\" + c if c in "*?\\" else c for c in rule)
    return (safe + "**", "*." + safe + "**")


def parse(glob: str) -> tuple[list[int | None], list[str]]:
    """The bytes of a glob (None: any), and the wildcard that follows each place from the start on ('', '*' or '**')."""
    marks: list[int | None] = []
    stays = [""]
    raw, k = glob.encode(), 0
    while k < len(raw):
        if raw[k] == ord("*"):
            n = 1
            while raw[k + n : k + n + 1] == b"*":
                n += 1
            stays[-1] = "**" if n > 1 or stays[-1] == "**" else "*"
            k += n
            continue
        if raw[k] == ord("\\") and k + 1 < len(raw):
            k += 1
            marks.append(raw[k])
        else:
            marks.append(None if raw[k] == ord("?") else raw[k])
        stays.append("")
        k += 1
    return marks, stays


class Automaton:
    """All globs at once. match() gives, for each URL, which of them fit the whole of it."""

    def __init__(self, globs: list[str]):
        parsed = [parse(g) for g in globs]
        self.globs = len(globs)
        total = sum(len(m) + 1 for m, _ in parsed)
        self.words = max(1, -(-total // 64))
        enter = np.zeros((256, self.words * 64), dtype=bool)  # may a state be entered by this byte
        stay = np.zeros((256, self.words * 64), dtype=bool)  # may a state be kept by it
        start = np.zeros(self.words * 64, dtype=bool)
        self.ends, at = [], 0
        for marks, stays in parsed:
            start[at] = True
            for k, mark in enumerate([*marks, -1]):
                if stays[k]:
                    stay[:, at + k] = True
                    if stays[k] == "*":
                        stay[SLASH, at + k] = False
                if mark is None:
                    enter[:, at + k + 1] = True
                elif mark >= 0:
                    enter[mark, at + k + 1] = True
            at += len(marks) + 1
            self.ends.append(at - 1)
        pack = lambda x: np.packbits(x.reshape(*x.shape[:-1], self.words, 64), axis=-1, bitorder="little").view("<u8")[..., 0]
        self.enter, self.stay, self.start = pack(enter), pack(stay), pack(start)

    def match(self, urls: list[bytes]) -> np.ndarray:
        n = len(urls)
        lens = np.fromiter(map(len, urls), dtype=np.int64, count=n)
        order = np.argsort(-lens, kind="stable")
        raw = np.frombuffer(b"".join(urls) + b"\0", dtype=np.uint8)
        first, left = (np.cumsum(lens) - lens)[order], lens[order]
        state = np.tile(self.start, (n, 1))
        for k in range(int(lens.max(initial=0))):
            live = int(np.searchsorted(-left, -k, side="left"))
            byte, now = raw[first[:live] + k], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.enter[byte] | now & self.stay[byte]
        out = np.empty((n, self.globs), dtype=bool)
        ends = np.array(self.ends)
        out[order] = state[:, ends >> 6] >> (ends & 63).astype(np.uint64) & np.uint64(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then up to '?' or '#'. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page (page_id, url).

    The longest rule that fits gives the verdict; without one, a page whose host fits a blocked glob is
    blocked and any other allowed. Null urls and such without '://' have empty host and path and are
    allowed; repeated rows stay; an empty table gives no rows; other columns are not looked at.
    """
    named = [(g, rule, verdict) for rule, verdict in rules for g in rule_globs(rule)]
    # A host glob is held against the host alone: the automaton's '/' ends it.
    hosts = [g for b in blocked for g in (b.replace("**", "*"), b.replace("**", "*") + "/**")]
    automaton = Automaton([g for g, _, _ in named] + hosts)
    order = sorted(range(len(named)), key=lambda i: len(named[i][1]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.match([(h + p).encode() for h, p in zip(host, path)])
            best = np.full(len(host), -1)
            for i in order:
                best[hit[:, i]] = i
            bad = hit[:, len(named) :].any(axis=1)
            rule = [named[i][1] if i >= 0 else None for i in best.tolist()]
            verdict = [named[i][2] if i >= 0 else "block" if b else "allow" for i, b in zip(best.tolist(), bad.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host LIKE '%casino%' OR host LIKE '%free-bets%' OR host LIKE '%xxx%' OR host LIKE '%porn%' OR host LIKE '%viagra%' OR host LIKE '%torrent%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

"""URL filters: all glob rules at once by a bit-parallel automaton.

Rules are globs over canonical URLs (`*` any run of characters, `?` any one).
Their characters lie one after another in a vector of bits, several 64-bit
words long; a set bit says that the rule's prefix up to there has matched.  A
character shifts all bits by one place and ANDs them with its mask
(Shift-And); positions before a `*` stay set.  A whole batch of URLs takes each
step together, so cost grows with characters and words of bits, not with rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import mapped

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    block: bool = True


RULES = (
    Rule("spam_farm", "*://*spam-farm.*"),
    Rule("pills", "*://*pills*.*/*"),
    Rule("casino", "*://*casino*.*"),
    Rule("adult", "*://*adult*.*"),
    Rule("porn", "*://*porn*.*"),
    Rule("free_download", "*free-download*"),
    Rule("replica", "*replica-watch*"),
    Rule("essay_mill", "*://*essay-writ*"),
    Rule("payday", "*payday-loan*"),
    Rule("click_farm", "*://*click-farm.*"),
    Rule("link_farm", "*://*link-farm.*"),
    Rule("seo", "*://*seo-??????.*"),
    Rule("login", "*/login"),
    Rule("login_query", "*/login?*"),
    Rule("cart", "*/cart"),
    Rule("wp_admin", "*/wp-admin/*"),
    Rule("search_results", "*/search?*"),
    Rule("calendar", "*/calendar/????/??/*"),
    Rule("session", "*?*session*=*"),
    Rule("archive", "*.zip"),
    Rule("program", "*.exe"),
    Rule("image", "*.jp?g"),
    Rule("bare_address", "*://???.???.???.???/*"),
    Rule("paged", "*?*page=*", False),
    Rule("mobile", "*://m.*", False),
    Rule("blog", "*://blog.*", False),
    Rule("html_page", "*.html", False),
    Rule("reserved_domain", "*://*.example.???/*", False),
)

#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)="


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port, tracking parameter or trailing slash; parameters sorted; http read as https, www. dropped.

    A null URL is null; what isn't scheme://host... only loses its fragment and surrounding space.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)([?]?)(.*)$"
    part = lambda k: F.regexp_extract(plain, shape, k)
    scheme = F.regexp_replace(F.lower(part(1)), r"^http$", "https")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^[^@]*@", ""), r":(80|443)$", ""), r"^www[.]", "")
    path = F.regexp_replace(part(3), r"/+$", "")
    kept = F.filter(F.split(part(5), "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(kept), "&")
    built = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.rlike(plain, F.lit(shape)), built).otherwise(plain)


CANONICAL_SQL = r"""
select page_id, url, case when regexp_matches(plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)([?]?)(.*)$') then
  scheme || '://' || host || (case when path = '' then '/' else path end) || (case when query = '' then '' else '?' || query end) else plain end as canonical_url
from (select *, regexp_replace(lower(regexp_extract(plain, shape, 1)), '^http$', 'https') as scheme,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, shape, 2)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '') as host,
  regexp_replace(regexp_extract(plain, shape, 3), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, shape, 5), '&'), lambda x: x <> '' and not regexp_matches(x, '{tracking}'))), '&') as query
  from (select page_id, url, regexp_replace(trim(url), '#.*$', '') as plain, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)([?]?)(.*)$' as shape from pages))
""".replace("{tracking}", TRACKING)


class Automaton:
    """Shift-And over UTF-8 bytes for many globs; `?` takes a lead byte and stays for the character's other bytes."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int, bool]] = []  # (byte, or -1 for any; whether a star follows)
        starts, ends = [], []
        for glob in globs:
            raw = glob.encode()
            starts.append(len(places))
            # Place 0 of a rule is the state "nothing read yet"; a star before the first character keeps it.
            places.append((-2, raw[:1] == b"*"))
            for k, c in enumerate(raw):
                if c != 42:
                    places.append((-1 if c == 63 else c, raw[k + 1 : k + 2] == b"*"))
            ends.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        bit = lambda k: (k // 64, _U(1 << (k % 64)))
        self.masks = np.zeros((256, self.words), dtype=np.uint64)
        self.begin, self.stay = np.zeros(self.words, dtype=np.uint64), np.zeros((256, self.words), dtype=np.uint64)
        for k, (byte, star) in enumerate(places):
            w, b = bit(k)
            if byte == -1:
                self.masks[:128, w] |= b
                self.masks[192:, w] |= b
                self.stay[128:192, w] |= b
            elif byte >= 0:
                self.masks[byte, w] |= b
            if star:
                self.stay[:, w] |= b
        for k in starts:
            w, b = bit(k)
            self.begin[w] |= b
        self.accept = [(k // 64, _U(k % 64)) for k in ends]

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix (row, rule): whether the rule's glob matches the whole row."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        at, long = offsets[:-1][order], sizes[order]
        state = np.tile(self.begin, (n, 1))
        live = n
        for step in range(int(long[0]) if n else 0):
            live = int(np.searchsorted(-long[:live], -step, side="left")) if live else 0
            now = state[:live]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            byte = data[at[:live] + step]
            moved &= self.masks[byte]
            moved |= now & self.stay[byte]
            state[:live] = moved
        out = np.zeros((n, len(self.accept)), dtype=bool)
        for r, (w, b) in enumerate(self.accept):
            out[order, r] = (state[:, w] >> b) & _U(1)
        return out


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, url, canonical_url, rules, keep) of every row; rules: names of the matching rules in order, joined by commas.

    keep is false if a blocking rule matches.  A null URL has a null canonical
    form, matches nothing and is kept; the empty URL is matched like any other.
    Repeated rows and null ids pass through; other columns aren't read.
    """
    names, blocking = [r.name for r in rules], np.array([r.block for r in rules], dtype=bool)
    globs = [r.glob for r in rules]

    def run(batches):
        automaton = Automaton(globs)
        for batch in batches:
            for part in tv.slices(batch, "canonical_url"):
                data, offsets = tv.buffers(part.column("canonical_url"))
                hit = automaton.match(data, offsets)
                hit[~part.column("canonical_url").is_valid().to_numpy(zero_copy_only=False)] = False
                kinds, index = np.unique(np.packbits(hit, axis=1), axis=0, return_inverse=True)
                label = [",".join(n for n, h in zip(names, np.unpackbits(k)[: len(names)]) if h) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(label, type=pa.string()).take(pa.array(index.reshape(-1))), pa.array(~(hit & blocking).any(axis=1))], ["page_id", "url", "canonical_url", "rules", "keep"])

    source = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"))
    source = source.withColumn("canonical_url", canonical(F.col("url")))
    return mapped(source, run, "page_id long, url string, canonical_url string, rules string, keep boolean")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL, each glob by the GLOB operator."""
    cases = ", ".join(f"case when canonical_url glob '{r.glob}' then '{r.name}' end" for r in rules)
    blocked = " or ".join(f"coalesce(canonical_url glob '{r.glob}', false)" for r in rules if r.block)
    return f"with c as ({CANONICAL_SQL}) select page_id, url, canonical_url, array_to_string(list_filter([{cases}], lambda x: x is not null), ',') as rules, not ({blocked}) as keep from c"

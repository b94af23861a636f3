"""The scan of rate files for a search: a semi-join inside the file's task, so that only what can match leaves it.

A reference passes if its bytes hold a wanted number, and its group ids are kept for the rest of the file. A rate
passes if its bytes hold a wanted number, or one of the ids in a list of references. What passes is a superset of what
matches; the search's own joins decide. Where rates stand before references, they are read a second time with the
ids that are known then, and only what did not pass before passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from ratelens.sources.mrf import SECTIONS, by_file, file_elements

#: So many numbers are sent to every task at most; a larger table of numbers is joined after the scan.
MOST_TARGETS = 1_000_000
#: Up to so many numbers are one pattern; more are looked up in a set.
_PATTERN = 50
_DIGITS = re.compile(rb"[0-9]++")
_LISTED = re.compile(rb"""["']provider_references["']\s*+:\s*+\[([^\]]*+)\]""")
_GROUP = re.compile(rb"""["']provider_group_id["']\s*+:\s*+([^,}\s]++)""")


class Wanted:
    """Whether bytes hold the digits of one of the numbers."""

    def __init__(self, npis: Iterable[int]):
        self.texts = frozenset(str(abs(int(n))).encode() for n in npis)
        few = len(self.texts) <= _PATTERN
        self.pattern = re.compile(b"|".join(sorted(self.texts)) or b"(?!)") if few else None

    def __call__(self, raw: bytes) -> bool:
        if self.pattern is not None:
            return self.pattern.search(raw) is not None
        return not self.texts.isdisjoint(_DIGITS.findall(raw))


class Groups:
    """The ids of the groups that matched so far in a file; all groups, where an id could not be told."""

    def __init__(self) -> None:
        self.ids: frozenset[float] = frozenset()
        self.all = False
        self._texts: dict[bytes, bool] = {}

    def add(self, raw: bytes) -> None:
        found, escaped = _GROUP.findall(raw), b"\\u" in raw
        try:
            new = self.ids | {float(x) for x in found if x != b"null"}
        except ValueError:
            escaped, found, new = True, [], self.ids
        if escaped and not found:
            self.all = True  # the key may be written with escapes
        if new != self.ids:
            self.ids, self._texts = new, {}

    def known(self) -> tuple[frozenset[float], bool]:
        return self.ids, self.all

    def __call__(self, raw: bytes) -> bool:
        """Whether a rate's bytes refer to one of the groups."""
        if self.all:
            return True
        if not self.ids:
            return False
        lists = _LISTED.findall(raw)
        if not lists:
            return b"\\u" in raw
        for listed in lists:
            for text in listed.split(b","):
                hit = self._texts.get(text)
                if hit is None:
                    try:
                        hit = float(text) in self.ids
                    except ValueError:
                        hit = False
                    if len(self._texts) > 1 << 20:
                        self._texts.clear()
                    self._texts[text] = hit
                if hit:
                    return True
        return False


def matching(path: str, wanted: Wanted, all_references: bool = False, length: int | None = None) -> Iterator[tuple[str, int, int, bytes | None]]:
    """The elements of a file that can match, as ``elements`` gives them; with ``all_references`` all of those."""
    groups, before = Groups(), {}
    for section, order, pos, raw in file_elements(path, SECTIONS, length):
        if raw is None:
            before[order] = groups.known()
            yield section, order, pos, raw
        elif section == "provider_references":
            if hit := wanted(raw):
                groups.add(raw)
            if hit or all_references:
                yield section, order, pos, raw
        elif wanted(raw) or groups(raw):
            yield section, order, pos, raw
    late = {order for order, known in before.items() if known != groups.known()}
    if not late:
        return
    for section, order, pos, raw in file_elements(path, SECTIONS, length):
        if raw is None or order not in late or section == "provider_references" or not groups(raw) or wanted(raw):
            continue
        then = Groups()
        then.ids, then.all = before[order]
        if not then(raw):
            yield section, order, pos, raw


def read_matching(files: DataFrame, npis: Iterable[int], all_references: bool = False) -> DataFrame:
    """Raw elements of all files (file_seq, source_file, maybe length) that a search for the numbers can use, and the
    rows that say which sections are there. The search gives the same as on ``read_elements``."""
    wanted = Wanted(npis)
    return by_file(files, lambda path, length: matching(path, wanted, all_references, length))


def few_enough(npis: Iterable[int] | DataFrame, most: int = MOST_TARGETS) -> list[int] | None:
    """The numbers, if they are ``most`` or fewer; a table of more stays a table."""
    if not isinstance(npis, DataFrame):
        return sorted({int(n) for n in npis})
    found = npis.select("npi").filter("npi is not null").distinct().limit(most + 1).toArrow().column("npi").to_pylist()
    return sorted(found) if len(found) <= most else None

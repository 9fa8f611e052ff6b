"""Which columns of two tables are compared: shared names, explicit links, and warnings on headers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnLink:
    """A feature: its name, and the places of its column in the target's and the supplemental's header."""

    name: str
    target: int
    supplemental: int


# Header patterns that may hold personal data, and why; the first that matches counts.
PERSONAL = (
    (r"\bfirst.?name\b", "May contain first names"),
    (r"\blast.?name\b", "May contain last names"),
    (r"\bname\b", "May contain personal names"),
    (r"\bssn\b", "May contain Social Security Numbers"),
    (r"\bdob\b|\bbirth", "May contain dates of birth"),
    (r"\baddress\b", "May contain street addresses"),
    (r"\bphone\b", "May contain phone numbers"),
    (r"\bemail\b", "May contain email addresses"),
    (r"\bzip\b", "May contain ZIP codes"),
    (r"\bpatient\b", "May contain patient identifiers"),
    (r"\bmrn\b", "May contain medical record numbers"),
    (r"\bgeoid\b", "May contain geographic identifiers"),
    (r"\btract\b", "May contain census tract IDs"),
)


def _stripped(headers: Iterable[str]) -> list[str]:
    return [h.strip() for h in headers]


def ambiguous_headers(target: Sequence[str], supplemental: Sequence[str], exclude: Iterable[str] = ()) -> list[str]:
    """Shared names that come twice or more on either side, sorted."""
    left, right = Counter(_stripped(target)), Counter(_stripped(supplemental))
    skip = set(_stripped(exclude)) | {""}
    return sorted(n for n in left.keys() & right.keys() if n not in skip and max(left[n], right[n]) > 1)


def suggest_links(target: Sequence[str], supplemental: Sequence[str], exclude: Iterable[str] = ()) -> list[ColumnLink]:
    """Links of all shared names in the target's order; ambiguous ones are left out."""
    unclear = set(ambiguous_headers(target, supplemental)) | set(_stripped(exclude)) | {""}
    places = {n: k for k, n in enumerate(_stripped(supplemental))}
    return [ColumnLink(n, k, places[n]) for k, n in enumerate(_stripped(target)) if n in places and n not in unclear]


def common_links(target: Sequence[str], supplemental: Sequence[str], exclude: Iterable[str] = ()) -> list[ColumnLink]:
    """Links of all shared names; a name that is ambiguous and not excluded is an error."""
    exclude = list(exclude)
    if unclear := ambiguous_headers(target, supplemental, exclude):
        raise ValueError(f"Duplicate column name(s) shared between the files: {', '.join(unclear)} — rename or exclude them; matching on an ambiguous column is unsafe.")
    return suggest_links(target, supplemental, exclude)


def validated(links: Sequence[ColumnLink]) -> list[ColumnLink]:
    """The links, if no name and no column of either side comes twice."""
    faults = []
    for what, values in (("feature name", [x.name for x in links]), ("target column", [x.target for x in links]), ("supplemental column", [x.supplemental for x in links])):
        faults += [f"{what} {v!r} is linked {n} times" for v, n in Counter(values).items() if n > 1]
    if faults:
        raise ValueError("Invalid column links: " + "; ".join(faults))
    return list(links)


def without(links: Sequence[ColumnLink], excluded: Iterable[str]) -> list[ColumnLink]:
    """The active links; none left is an error."""
    skip = set(excluded)
    active = [x for x in links if x.name not in skip]
    if not active:
        raise ValueError("No active column links: every link is excluded.")
    return active


def add_link(links: Sequence[ColumnLink], target: Sequence[str], target_at: int, supplemental_at: int) -> list[ColumnLink]:
    """A further link, named after the target's header."""
    return validated([*links, ColumnLink(target[target_at].strip(), target_at, supplemental_at)])


def unlinked(links: Sequence[ColumnLink], headers: Sequence[str], side: str) -> list[int]:
    """Places of the columns of one side (``target`` or ``supplemental``) that no link has."""
    used = {getattr(x, side) for x in links}
    return [k for k in range(len(headers)) if k not in used]


def personal_headers(headers: Iterable[str], dataset: str) -> list[tuple[str, str, str]]:
    """(dataset, header, reason) of headers that may hold personal data, one a header."""
    found = []
    for header in headers:
        reason = next((why for pattern, why in PERSONAL if re.search(pattern, header, re.IGNORECASE)), None)
        if reason:
            found.append((dataset, header, reason))
    return found

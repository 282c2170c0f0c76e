"""Repository paths: checks for single values, and the same rules as Columns for whole tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STAGED = "+staged"


def _no_control(text: str, what: str) -> None:
    if "\0" in text:
        raise ValueError(f"{what} contains null bytes")
    if any(ord(c) < 32 for c in text):
        raise ValueError(f"{what} contains control characters")


def normalize_path(path: str, what: str = "Path") -> str:
    """path without outer space and trailing slashes; ValueError if it isn't a relative path below the root."""
    _no_control(path, what)
    path = path.strip()
    if path.startswith("/"):
        raise ValueError(f"{what} cannot be absolute")
    path = path.rstrip("/")
    if not path:
        raise ValueError(f"{what} cannot be empty")
    parts = path.split("/")
    if path == "." or ".." in parts:
        raise ValueError(f"{what} cannot traverse outside the repository root")
    if "" in parts:
        raise ValueError(f"{what} contains empty components")
    return path


def normalize_paths(paths: Iterable[str]) -> list[str]:
    """Normalized paths in their order, each once."""
    return list(dict.fromkeys(normalize_path(p) for p in paths))


def normalize_patterns(patterns: Iterable[str] | None) -> list[str]:
    return [normalize_path(p, "Import path filter") for p in patterns or ()]


def is_entry_path(path: Column) -> Column:
    r"""Whether path is a valid entry path: relative, without empty, `.` or `..` parts, and without backslashes."""
    return (path != "") & ~path.rlike(r"(^|/)(\.{0,2})(/|$)") & ~path.contains("\\") & ~path.rlike(r"[\x00-\x1f]")


def under(path: Column, prefix: str) -> Column:
    """Component-wise: path is prefix, or lies below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def under_any(path: Column, prefixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | under(path, prefix)
    return found


def ancestors(path: Column) -> Column:
    """path and each directory above it: under() as an equality, so that many prefixes make a hash join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def directory(path: Column) -> Column:
    """The directory of path, '' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """A regular expression for pattern, matched from the right by whole components: `*` and `?` stay within one, and
    `**` is one component, save that `**/name` also matches a name at the top."""
    relaxed = pattern.startswith("**/") and "/" not in pattern[3:]
    parts = [p for p in (pattern[3:] if relaxed else pattern).split("/") if p != "."]

    def part(glob: str) -> str:
        out, i = [], 0
        while i < len(glob):
            c = glob[i]
            i += 1
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
                chosen = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out.append(f"[^/{chosen[1:]}]" if chosen[:1] == "!" else f"(?!/)[{chosen}]")
                i = end + 1
            else:
                out.append(re.escape(c))
        return re.sub(r"(\[\^/\]\*)+$", "[^/]+", "".join(out)) if set(glob) == {"*"} else "".join(out)

    return "^(.*/)?" + "/".join(map(part, parts)) + "$"


def matches_glob(path: Column, patterns: Iterable[str]) -> Column:
    """Whether path matches any of the patterns; no patterns match everything."""
    found = [path.rlike(glob_regex(p)) for p in patterns]
    if not found:
        return F.lit(True)
    out = found[0]
    for one in found[1:]:
        out = out | one
    return out


def relative_key(key: Column, size: Column, prefix: str) -> Column:
    """The path of an object-store key below prefix: null for directory markers, an error for keys outside prefix.
    A key equal to the prefix gives its last component."""
    bare, prefix = F.regexp_replace(key, "^/+|/+$", ""), prefix.strip("/")
    marker = (key.endswith("/") & (size == 0)) | (bare == "")
    if not prefix:
        return F.when(~marker, bare)
    outside = F.raise_error(F.concat(F.lit("key '"), key, F.lit(f"' is outside import prefix '{prefix}'")))
    return F.when(marker, F.lit(None)).when(bare == prefix, basename(bare)).when(bare.startswith(prefix + "/"), F.substring(bare, len(prefix) + 2, 1 << 30)).otherwise(outside.cast("string"))


@dataclass(frozen=True)
class DatasetURI:
    dataset: str
    ref: str
    path: str
    staged: bool = False


def parse_uri(uri: str, scheme: str = "strata", allow_empty_path: bool = False) -> DatasetURI:
    """scheme://dataset@ref[+staged]/path. The ref ends at the first slash; slashes around the path are dropped."""
    rest = uri.removeprefix(f"{scheme}://")
    if not rest:
        raise ValueError("URI cannot be empty")
    dataset, at, rest = rest.partition("@")
    if not at:
        raise ValueError(f"URI must include a ref: {scheme}://<dataset>@<ref>/<path>")
    ref, _, path = rest.partition("/")
    staged = ref.endswith(STAGED)
    ref = ref.removesuffix(STAGED)
    for what, value in (("dataset", dataset), ("ref", ref)):
        _no_control(value, f"URI {what}")
        if not value:
            raise ValueError(f"URI {what} cannot be empty")
        if "/" in value:
            raise ValueError(f"URI {what} cannot contain path separators")
        if value in (".", ".."):
            raise ValueError(f"URI {what} cannot be '.' or '..'")
    path = path.strip("/")
    if path:
        path = normalize_path(path)
    elif not allow_empty_path:
        raise ValueError("URI must include a logical file path")
    return DatasetURI(dataset, ref, path, staged)

"""Scalar functions over paths, remotes, titles and commands, as column expressions."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"

# Generated and vendored files left out of coverage by default.
DEFAULT_IGNORED = (
    "**/.git/**", "**/.next/**", "**/.nuxt/**", "**/__pycache__/**", "**/node_modules/**", "*.map", "*.min.css", "*.min.js", "bun.lockb", "Cargo.lock", "composer.lock", "Gemfile.lock",
    "go.sum", "npm-shrinkwrap.json", "package-lock.json", "packages.lock.json", "paket.lock", "pdm.lock", "Pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "yarn.lock",
)

# Commands that rate a conversation; a deployment may add its own.
RATING_COMMANDS = ("/bb", "/bb:rate", "/brate", "$bb")


def strip_space(text: Column) -> Column:
    """text without any Unicode white space: how lines are compared."""
    return F.regexp_replace(text, r"(?U)\s", "")


def has_text(line: Column) -> Column:
    """Whether strip_space leaves anything of a line, without making it."""
    return F.regexp_like(line, F.lit(r"(?U)\S"))


def token_path(path: Column) -> Column:
    """Forward slashes, trimmed, one leading ./ and then one leading / removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.translate(path, "\\", "/")), r"^\./", ""), "^/", "")


def header_path(path: Column) -> Column:
    """The path of a ---/+++ line: cut at a tab or space, a/ or b/ removed; /dev/null is ''."""
    cut = F.regexp_extract(F.trim(path), r"^([^\t ]*)", 1)
    return F.when(cut == "/dev/null", "").otherwise(F.regexp_replace(F.regexp_replace(cut, "^a/", ""), "^b/", ""))


def path_aliases(path: Column) -> Column:
    """The path and each suffix of three or more segments, longest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    suffixes = F.when(
        F.size(parts) > 3, F.transform(F.sequence(F.lit(2), F.size(parts) - 2), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(path), suffixes))


@lru_cache(1 << 14)
def aliases_of(path: str | None) -> list[str]:
    """path_aliases of one path, for folds; of no path none."""
    if path is None:
        return []
    parts = [p for p in path.split("/") if p]
    return list(dict.fromkeys([path, *("/".join(parts[i:]) for i in range(1, len(parts) - 2))]))


def match_keys(path: Column, sign: Column, norm: Column) -> Column:
    return F.transform(path_aliases(path), lambda a: F.concat_ws(SEPARATOR, a, sign, norm))


def attributable(norm: Column) -> Column:
    """Lines of punctuation alone say nothing about their author."""
    return F.regexp_like(norm, F.lit(r"[\p{L}\p{Nd}]"))


def percentage(part: Column, total: Column) -> Column:
    return F.when(total > 0, part * 100.0 / F.nullif(total, F.lit(0))).otherwise(0.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_key(path: Column) -> Column:
    """The last dot and what follows in lower case, or the base name if it has none."""
    base = base_name(path)
    extension = F.regexp_extract(base, r"\.[^.]*$", 0)
    return F.when(extension != "", F.lower(extension)).otherwise(base)


def repo_key(remote: Column, most: int | None = None) -> Column:
    """host/owner/repo in lower case of an ssh, scp-like, git or http remote; '' otherwise.

    Sub-groups stay in the key, so that repositories of one name in two sub-groups are two; `most` segments cut it to host/owner/repo.
    """
    pattern = r"^(?:(?:https?|ssh|git)://)?(?:[^@/]+@)?([^/:]+)(?::\d+)?[:/](.+?)(?:\.git)?/?$"
    host, path = F.regexp_extract(F.trim(remote), pattern, 1), F.regexp_extract(F.trim(remote), pattern, 2)
    key = F.concat(host, F.lit("/"), path)
    return F.when((host != "") & path.contains("/"), F.lower(key if most is None else F.substring_index(key, "/", most))).otherwise("")


def commit_url(remote: Column, commit_hash: Column) -> Column:
    """The page of a commit at the forge of a remote."""
    key = repo_key(remote)
    middle = F.when(key.startswith("bitbucket.org/"), "/commits/").when(key.contains("gitlab"), "/-/commit/").otherwise("/commit/")
    return F.when(key != "", F.concat(F.lit("https://"), key, middle, commit_hash)).otherwise("")


def title(text: Column, most: int = 1000) -> Column:
    """One title line: leading markup tag skipped, cut after `most` characters."""
    plain = F.trim(F.regexp_replace(text, r"^\s*<[^>]*>\s*", ""))
    return F.when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)


def summary_title(text: Column) -> Column:
    """A summary without its wrapping ** or __."""
    return F.trim(F.regexp_replace(F.trim(text), r"^(\*\*|__)(.*?)\1$", "$2"))


def preview(text: Column, most: int = 120) -> Column:
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def _commands(commands: tuple[str, ...]) -> str:
    return "|".join(re.escape(c) for c in sorted(commands, key=len, reverse=True))


def plain_command(text: Column) -> Column:
    """A command given as a Markdown link, as the command itself."""
    return F.trim(F.regexp_replace(F.trim(text), r"^\[([^\]]+)\]\([^)]*\)", "$1"))


def rating_command(text: Column, commands: tuple[str, ...] = RATING_COMMANDS) -> Column:
    """struct(rating, note) of a rating command with a rating of 0 to 5, null for other texts."""
    pattern = rf"(?s)^(?:{_commands(commands)})\s+([0-5])(?: (.*))?$"
    rating = F.regexp_extract(plain_command(text), pattern, 1)
    return F.when(rating != "", F.struct(rating.cast("int").alias("rating"), F.trim(F.regexp_extract(plain_command(text), pattern, 2)).alias("note")))


def is_rating_command(text: Column, commands: tuple[str, ...] = RATING_COMMANDS) -> Column:
    return F.regexp_like(plain_command(text), F.lit(rf"^(?:{_commands(commands)})(?:\s|$)"))


def encode_project_path(path: Column) -> Column:
    """A path as a directory name."""
    return F.translate(path, "\\/:.", "----")


def without_worktree(path: Column) -> Column:
    """The project of a worktree kept below it."""
    return F.regexp_replace(path, r"/\.[^/]+/worktrees/.*$", "")


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def percent_label(percent: Column) -> Column:
    """Whole percent, with one decimal where rounding would say 0 or 100."""
    edge = ((percent > 0) & (percent < 1)) | ((percent > 99) & (percent < 100))
    return F.when(edge, F.format_string("%.1f%%", percent)).otherwise(F.concat(F.round(percent).cast("int").cast("string"), F.lit("%")))


def epoch_ms(value: Column) -> Column:
    """Milliseconds of a number or text in epoch seconds, epoch milliseconds or ISO 8601; null otherwise."""
    text = F.trim(value.cast("string"))
    number = F.when(F.regexp_like(text, F.lit(r"^\d+(?:\.\d+)?$")), text).cast("double")
    stamp = F.unix_millis(F.try_to_timestamp(F.when(~F.regexp_like(text, F.lit(r"^\d+(?:\.\d+)?$")), text)))
    return F.coalesce(F.when(number > 1e12, number.cast("long")).otherwise((number * 1000).cast("long")), stamp)


def local_date(ms: Column, zone: str | None = None, offset_minutes: int = 0) -> Column:
    """The day of an instant in a named zone, else at a fixed offset counted west of UTC, as browsers give it."""
    stamp = F.timestamp_millis(ms)
    if zone:
        return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz")))
    return F.to_date(F.timestamp_millis(ms - offset_minutes * 60_000).cast("timestamp_ntz"))


def lines(text: Column) -> Column:
    """A newline-separated list as an array, trimmed and without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def glob_regex(pattern: str) -> str:
    """A regular expression of a glob over a whole path; ** spans segments, and a pattern without / fits any segment."""
    pattern = pattern.replace("\\", "/").strip().removeprefix("./").lstrip("/")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"(?:.*/)?{out}(?:/.*)?" if "/" not in pattern else out


def ignored_path(path: Column, patterns: str | None = None, defaults: bool = True) -> Column:
    """Whether a path meets a newline-separated list of globs or the default list."""
    own = [p.strip() for p in (patterns or "").split("\n") if p.strip()] + list(DEFAULT_IGNORED if defaults else ())
    if not own:
        return F.lit(False)
    return F.regexp_like(path, F.lit("^(?:" + "|".join(glob_regex(p) for p in own) + ")$"))


def below(path: Column, folder: Column) -> Column:
    """path is folder or lies in it."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def pattern_difference(before: Column, after: Column) -> Column:
    """Patterns that are in one list only."""
    return F.array_sort(F.array_union(F.array_except(before, after), F.array_except(after, before)))


def line_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of trimmed, non-blank lines; 1 for two empty sets."""
    x, y = F.array_distinct(lines(a)), F.array_distinct(lines(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0))).otherwise(1.0)


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *columns), 256)


def common_folder(paths: Column) -> Column:
    """The longest folder that holds all paths of an array."""
    parts = F.transform(paths, lambda p: F.split(p, "/"))

    def shared(a: Column, b: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda i: F.get(a, i) == F.get(b, i))
        first_off = F.array_position(same, False)
        return F.slice(a, 1, F.when(first_off > 0, first_off - 1).otherwise(F.size(same)))

    return F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.get(parts, 0), shared), "/")


def within(path: Column, folders: list[str] | None) -> Column:
    """path is one of the folders or lies in it; no list at all lets every path through, an empty one none."""
    if folders is None:
        return F.lit(True)
    out = F.lit(False)
    for folder in folders:
        out = out | below(path, F.lit(folder))
    return out


def added_paths(before: Column, after: Column) -> Column:
    """Paths of the second list that the first hasn't, in their order."""
    return F.array_except(after, before)


def own_home(path: Column, foreign: str, home: str) -> Column:
    """A path below a mounted home of another machine, below the own one."""
    return F.when(below(path, F.lit(foreign)), F.concat(F.lit(home), F.substr(path, F.lit(len(foreign) + 1)))).otherwise(path)


def datetime_ms(text: Column) -> Column:
    """Milliseconds of a UTC date and time given as text; null for other texts."""
    return F.unix_millis(F.try_to_timestamp(text))


def date_range(preset: str, today: str, first: str = "", last: str = "") -> tuple[str, str]:
    """[start, end) in days of a preset (7d to 365d, up to and with today), or of two dates in either order, the later one included."""
    if preset != "custom":
        first, last = (date.fromisoformat(today) - timedelta(days=int(preset.removesuffix("d")) - 1)).isoformat(), today
    first, last = sorted((first, last))
    return first, (date.fromisoformat(last) + timedelta(days=1)).isoformat()


SKILL_TEXT = "base directory for this skill:"


def is_rating_workflow(text: Column, commands: tuple[str, ...] = RATING_COMMANDS, skill: str = "rate") -> Column:
    """A rating command, or the text of the rating skill that a tool puts in."""
    low = F.lower(F.trim(text))
    injected = low.startswith(SKILL_TEXT) & (low.contains(skill) | low.contains("the user wants to rate this conversation."))
    return is_rating_command(text, commands) | injected

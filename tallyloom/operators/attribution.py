"""Attribution of commit lines to agent messages: exact, formatting, quote-style and fallback passes, deletions, roll-ups.

Tables here: commit tokens (commit_id, position, path, sign, norm, style, keys,
attributable) and message tokens (message_id, conversation_id, agent, timestamp,
position, path, sign, norm, style, keys). A commit may use messages of
(authored_at - LOOK_BACK, authored_at + LOOK_AHEAD], in milliseconds. What a commit
uses is its own affair: two commits may claim one message line.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.runs import joined, text_run
from ..functions.text import SEPARATOR, aliases_of, attributable, percentage
from ..session import kept, stored
from .commits import touches_patterns
from .groups import fold_groups, sweep_groups

DAY = 24 * 3600 * 1000
LOOK_BACK, LOOK_AHEAD = 7 * DAY, 5 * 60 * 1000
WINDOW = LOOK_BACK + LOOK_AHEAD
#: Lines joined at most on either side by the formatting pass.
FORMATTING_LINES = 5


def in_window(authored_ms, timestamp):
    return (timestamp > authored_ms - LOOK_BACK) & (timestamp <= authored_ms + LOOK_AHEAD)


def exact_by_rank(commit_tokens: DataFrame, message_tokens: DataFrame, key: str = "norm") -> DataFrame:
    """Greedy one-to-one matching on one key without any greedy step.

    If a token's only key is its text, the k-th commit token of a text takes the
    k-th newest message token of it, which is what taking the best unused one in
    turn does. Two windows and an equi join; no key's tokens meet in a product.
    Returns (commit_id, position, message_id, conversation_id, agent).
    """
    mine = commit_tokens.filter("attributable").withColumn("k", F.row_number().over(W.partitionBy("commit_id", key).orderBy("position")))
    newest = W.partitionBy(key).orderBy(F.desc("timestamp"), F.desc("message_id"), F.asc("position"))
    theirs = message_tokens.withColumn("k", F.row_number().over(newest)).select(key, "k", "message_id", "conversation_id", "agent")
    return mine.join(theirs, [key, "k"]).select("commit_id", "position", "message_id", "conversation_id", "agent")


#: Columns of a message token that a match carries.
SOURCE = ("message_id", "conversation_id", "agent", "timestamp")


def _times(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("id").alias("commit_id"), (F.col("authored_at") * 1000).alias("authored_ms"))


def _with_bins(owned: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of commits with their time and, in `bin`, the spans of LOOK_BACK that their window touches: the window becomes part of an equi join."""
    first, last = F.floor((F.col("authored_ms") - LOOK_BACK) / LOOK_BACK), F.floor((F.col("authored_ms") + LOOK_AHEAD) / LOOK_BACK)
    return owned.join(_times(commits), "commit_id").withColumn("bin", F.explode(F.sequence(first, last)))


def _bin():
    return F.floor(F.col("timestamp") / LOOK_BACK).alias("bin")


#: Spans of time in which rows are dealt, so long that few sources serve in two.
SPAN = 4 * WINDOW


def _ends():
    """When the window of a commit ends, and in which span."""
    end = F.col("authored_ms") + LOOK_AHEAD
    return end.alias("time"), F.floor(end / SPAN).alias("span")


def _serving(sources: DataFrame) -> DataFrame:
    """Sources in each span of time in which a window that holds them may end."""
    first, last = F.floor(F.col("timestamp") / SPAN), F.floor((F.col("timestamp") + WINDOW) / SPAN)
    return sources.withColumn("span", F.explode(F.array_distinct(F.array(first, last))))


def _take_in_turn(cluster: list[tuple]) -> list[tuple[str, int, tuple]]:
    """(path, position, source) for the tokens of one text of a commit that stand in several files: in order of position each takes the best source of its file that is left.

    Rows are pairs of a file (path, positions) and a source (message_id, place, ...), by path and then their rank for that file.
    """
    lists: dict[str, list[tuple]] = {}
    tokens = []
    for path, positions, *source in cluster:
        if path not in lists:
            lists[path] = []
            tokens += [(at, path) for at in positions]
        lists[path].append(tuple(source))
    next_of, used, out = dict.fromkeys(lists, 0), set(), []
    for at, path in sorted(tokens):
        own = lists[path]
        while next_of[path] < len(own) and own[next_of[path]][:2] in used:
            next_of[path] += 1
        if next_of[path] < len(own):
            source = own[next_of[path]]
            used.add(source[:2])
            out.append((path, at, source))
    return out


def _sweep_texts(events: DataFrame, columns: list[str], sweep, schema: str) -> DataFrame:
    """sweep_groups over the events of each text and span of time, by time; texts that only commits or only messages (commit_id null) have are left out before."""
    order = [F.asc("time"), F.asc_nulls_first("commit_id"), F.asc("message_id"), F.desc("position")]
    whole = W.partitionBy("text", "span").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = events.repartition("text", "span").withColumns({"asked": F.count("commit_id").over(whole), "all": F.count(F.lit(1)).over(whole)})
    return sweep_groups(rows.filter("asked BETWEEN 1 AND all - 1"), ["text", "span"], order, columns, sweep, schema, dealt=True)


class _Sources:
    """Lines of messages of a sliding window that have one text, by path, by alias of path and, for the conversation that goes first, by it too."""

    def __init__(self, scoped: bool):
        self.scoped = scoped
        self.written: deque[tuple] = deque()
        self.lists: dict[tuple, deque] = defaultdict(deque)

    def _keys(self, path: str | None, conversation: str) -> Iterator[tuple]:
        for scope in (None, conversation) if self.scoped else (None,):
            yield scope, "path", path
            for alias in aliases_of(path) or [path]:
                yield scope, "alias", alias

    def add(self, time: int, path: str | None, source: tuple) -> None:
        self.written.append((time, path, source))
        for key in self._keys(path, source[2]):
            self.lists[key].append(source)

    def forget(self, until: int) -> None:
        while self.written and self.written[0][0] <= until:
            _, path, source = self.written.popleft()
            for key in self._keys(path, source[2]):
                of = self.lists[key]
                of.popleft()
                if not of:
                    del self.lists[key]

    def best(self, path: str | None, n: int, main: str | None, used: set[tuple]) -> list[tuple]:
        """The n sources that a file takes first: of its main conversation, then of its very path, then of the longest shared path, then the newest."""
        out, seen = [], set(used)
        for scope in (main, None) if main is not None else (None,):
            for kind, name in (("path", path), *(("alias", alias) for alias in aliases_of(path) or [path])):
                for source in reversed(self.lists.get((scope, kind, name), ())):
                    if len(out) == n:
                        return out
                    if source[:2] not in seen:
                        seen.add(source[:2])
                        out.append(source)
        return out


def _meet(commits: DataFrame, mine: DataFrame, theirs: DataFrame, text: str, used: DataFrame | None = None) -> DataFrame:
    """(commit_id, position, path, sign, message_id, conversation_id, agent, place): one-to-one matches of lines of one text, each with the best source of the window that is left.

    mine: (commit_id, position, path, sign) and theirs, with digests in the column
    `text`; mine may have `main`, the conversation of the file that goes first. used:
    (commit_id, message_id, place, text), lines that are used up already. Rows of one
    text and span of time are read in order of time, without the texts: messages come in
    and go out as the window slides, and at its end a commit's lines of the text are
    settled in turn. No line needs more sources than the commit has lines of its text, so a file
    looks at no more. What is done goes with the lines and what comes out, not with
    how often a text was written.
    """
    none = F.lit(None).cast("string")
    scoped = "main" in mine.columns
    lines = mine.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"), "commit_id", "path", "sign", "position", none.alias("message_id"), (F.col("main") if scoped else none).alias("conversation_id"))
    if used is not None:
        lines = lines.unionByName(used.select("text", "commit_id", "message_id", F.col("place").alias("position")), allowMissingColumns=True)
    lines = lines.join(_times(commits), "commit_id").select("*", *_ends()).drop("authored_ms")
    sources = _serving(theirs.filter(F.col(text).isNotNull())).select(F.col(text).alias("text"), F.col("timestamp").alias("time"), "span", "message_id", "position", "path", "conversation_id", "agent")
    events = lines.unionByName(sources, allowMissingColumns=True)

    def sweep(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = _Sources(scoped)
        for commit, own in groupby(rows, key=itemgetter(0)):
            if commit is None:
                for _, time, path, _, position, message_id, conversation, agent in own:
                    held.add(time, path, (message_id, position, conversation, agent))
                continue
            files: dict[str, list] = {}
            gone, at_end = set(), None
            for _, time, path, sign, position, message_id, main, _ in own:
                at_end = time
                if message_id is not None:
                    gone.add((message_id, position))
                else:
                    files.setdefault(path, [sign, main, []])[2].append(position)
            held.forget(at_end - WINDOW)
            n = sum(len(positions) for _, _, positions in files.values())
            cluster = [(path, positions, *source) for path, (_, main, positions) in files.items() for source in held.best(path, n, main, gone)] if held.written else []
            for path, at, (message_id, place, conversation, agent) in _take_in_turn(cluster):
                yield commit, at, path, files[path][0], message_id, conversation, agent, place

    columns = ["commit_id", "time", "path", "sign", "position", "message_id", "conversation_id", "agent"]
    return _sweep_texts(events, columns, sweep, "commit_id string, position int, path string, sign string, message_id string, conversation_id string, agent string, place int")


#: Columns of a match; `used` are the positions of the message's lines that it uses up.
MATCH = ("commit_id", "position", "path", "sign", "message_id", "conversation_id", "agent", "pass", "used")


def _matches(found: DataFrame, name: str) -> DataFrame:
    return found.withColumns({"pass": F.lit(name), "used": F.array("place")}).select(*MATCH)


def _open(tokens: DataFrame, matched: DataFrame, with_main: bool = False) -> DataFrame:
    """Tokens that no match has yet, and in `main` the conversation with most matches of their file; all of a commit are dealt together."""
    rows = tokens.withColumns({"is_used": F.lit(None).cast("boolean"), "main": F.lit(None).cast("string")})
    rows = rows.unionByName(matched.select("commit_id", "position", F.lit(True).alias("is_used")), allowMissingColumns=True)
    if with_main:
        rows = rows.unionByName(dominant_conversation(matched, "commit_id", "path").select("commit_id", "path", F.col("conversation_id").alias("main")), allowMissingColumns=True)
    rows = rows.repartition("commit_id").withColumn("taken", F.max("is_used").over(W.partitionBy("commit_id", "position")))
    if with_main:
        rows = rows.withColumn("main", F.max("main").over(W.partitionBy("commit_id", "path")))
    rows = rows.filter("taken IS NULL AND position IS NOT NULL")
    return rows.select(*tokens.columns, *(["main"] if with_main else []))


def _spans(tokens: DataFrame, owner: str, others: list[str]) -> DataFrame:
    """Runs of one to FORMATTING_LINES tokens of one owner, path and sign: (owner, others, at, places, run), run a hash of the joined text, made of those of the tokens.

    at: eight times the first position, and how many there are; places: all positions, null if they follow one another.
    """
    order = W.partitionBy(owner, "path", "sign").orderBy("position")
    ahead = {f"t{k}": F.lead(F.struct("position", "run"), k).over(order) for k in range(FORMATTING_LINES)}
    rows = tokens.withColumns(ahead)
    rows = rows.withColumn("r1", F.col("t0.run"))
    for k in range(1, FORMATTING_LINES):
        rows = rows.withColumn(f"r{k + 1}", joined(F.col(f"r{k}"), F.col(f"t{k}.run")))  # null beyond the last token
    runs = []
    for width in range(1, FORMATTING_LINES + 1):
        run, last = F.col(f"r{width}"), F.col(f"t{width - 1}.position")
        apart = F.when(last - F.col("position") >= width, F.array(*[F.col(f"t{k}.position") for k in range(width)]))
        runs.append(F.struct((F.col("position").cast("long") * 8 + width).alias("at"), apart.alias("places"), F.when(run.isNotNull(), F.xxhash64("path", "sign", run["h1"], run["h2"], run["n"])).alias("run")))
    return rows.select(owner, *others, F.inline(F.array(*runs))).filter("run IS NOT NULL")


#: Files up to which those that both sides have are broadcast; beyond it their lines aren't sifted before they meet.
BROADCAST_FILES = 500_000


def formatting_matches(commits: DataFrame, mine: DataFrame, theirs: DataFrame, matched: DataFrame) -> DataFrame:
    """Open lines that a message has broken otherwise: runs of up to FORMATTING_LINES on either side whose joined text is the same, in one path and sign.

    Runs of both sides are known by a hash and meet in an equi join. From the first
    open line of a file on, the longest run that has a partner goes first, with the
    newest message, the shortest run there and the first such; a line is used once on
    either side. Only runs that have partners are settled so, one commit at a
    time. Two runs of one line each would have matched exactly. The hash of a run is
    made of those of its lines, so texts don't go through a shuffle.
    """
    mine = mine.filter("path != ''")
    both = theirs.select("path", "sign").distinct().join(mine.select("path", "sign").distinct(), ["path", "sign"], "left_semi").limit(BROADCAST_FILES + 1)
    both = stored(both)
    if both.count() <= BROADCAST_FILES:
        mine, theirs = (side.join(F.broadcast(both), ["path", "sign"], "left_semi") for side in (mine, theirs))
    mine = mine.join(_times(commits), "commit_id")
    mine, theirs = (side if "run" in side.columns else side.withColumn("run", text_run(F.col("norm"))) for side in (mine, theirs))
    own = _spans(mine.select("commit_id", "authored_ms", "path", "sign", F.col("position").cast("int").alias("position"), "run"), "commit_id", ["authored_ms"])
    own = own.withColumn("span", _ends()[1])
    near = theirs.filter("path != ''").select(*SOURCE, "path", "sign", F.col("position").cast("int").alias("position"), "run")
    other = _serving(_spans(near, "message_id", ["conversation_id", "agent", "timestamp", "path", "sign"]).withColumnsRenamed({"at": "their_at", "places": "their_places"}))
    own, other = (side.withColumn("run", F.xxhash64("run", "span")).drop("span") for side in (own, other))
    met = own.join(other, "run").filter(in_window(F.col("authored_ms"), F.col("timestamp")) & ((F.col("at") % 8 > 1) | (F.col("their_at") % 8 > 1))).drop("run", "authored_ms")
    rows = met.withColumn("is_used", F.lit(False)).unionByName(matched.select("commit_id", "message_id", F.col("used").alias("their_places"), F.lit(True).alias("is_used")), allowMissingColumns=True)

    def all_of(at: int, places: list[int] | None) -> list[int]:
        return list(range(at >> 3, (at >> 3) + at % 8)) if places is None else places

    def settle(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        lines, gone = set(), set()
        for is_used, at, places, path, sign, message_id, conversation_id, agent, their_at, their_places in found:
            used = all_of(their_at, their_places)
            theirs_ = {(message_id, p) for p in used}
            if is_used:
                gone |= theirs_
            elif lines.isdisjoint(positions := all_of(at, places)) and gone.isdisjoint(theirs_):
                lines.update(positions)
                gone |= theirs_
                for n, p in enumerate(positions):
                    yield key[0], p, path, sign, message_id, conversation_id, agent, [] if n else used

    # files of a commit have no line in common, so their runs may take turns
    first, width = (lambda c: F.shiftright(F.col(c), 3)), (lambda c: F.col(c) % 8)
    best_first = [F.desc("is_used"), first("at").asc(), width("at").desc(), F.desc("timestamp"), F.desc("message_id"), width("their_at").asc(), first("their_at").asc()]
    columns = ["is_used", "at", "places", "path", "sign", "message_id", "conversation_id", "agent", "their_at", "their_places"]
    return sweep_groups(rows, ["commit_id"], best_first, columns, settle, "commit_id string, position int, path string, sign string, message_id string, conversation_id string, agent string, used array<int>")


def style_matches(commits: DataFrame, mine: DataFrame, theirs: DataFrame, matched: DataFrame) -> DataFrame:
    """Open lines that differ from a message's in the kind of quotes alone; the conversation that wrote most of the file goes first, then as for equal lines.

    mine and theirs: as compact() makes them; mine has `main` as well.
    """
    used = matched.select("commit_id", "message_id", F.explode("used").alias("place"))
    sources = theirs.filter("style IS NOT NULL").select("message_id", F.col("position").alias("place"), F.col("style").alias("text"))
    return _matches(_meet(commits, mine, theirs, "style", used.join(sources, ["message_id", "place"])), "style")


def compact(tokens: DataFrame, *columns: str) -> DataFrame:
    """Tokens (columns, position, path, sign, text, style, run) with digests in place of their texts and hashes of them that can be joined."""

    def own(c: str):
        return F.unhex(F.md5(F.concat_ws(SEPARATOR, "sign", c)))

    style = F.when(F.coalesce(F.col("style"), F.lit("")) != "", own("style"))
    return tokens.select(*columns, F.col("position").cast("int").alias("position"), "path", "sign", own("norm").alias("text"), style.alias("style"), text_run(F.col("norm")).alias("run"))


def match_lines(commits: DataFrame, commit_tokens: DataFrame, message_tokens: DataFrame) -> DataFrame:
    """(commit_id, position, path, sign, message_id, conversation_id, agent, pass, used): matched lines of all commits, by three passes.

    Equal lines go first, then lines broken otherwise, then those that differ in quotes;
    a pass takes what the ones before have left on both sides. `used` are the positions
    of the message's lines that a match uses up. Tokens are read once and kept with
    digests in place of their texts; which of them count is sifted afterwards, as a
    filter would have their texts made again.
    """
    commits = kept(commits.select("id", "authored_at"))
    mine = kept(compact(commit_tokens, "commit_id", "attributable")).filter("attributable").drop("attributable")
    theirs = kept(compact(message_tokens.withColumn("attributable", attributable(F.col("norm"))), *SOURCE, "attributable")).filter("attributable").drop("attributable")
    exact = kept(_matches(_meet(commits, mine, theirs, "text"), "exact"))
    broken = kept(formatting_matches(commits, _open(mine.drop("text", "style"), exact), theirs, exact).withColumn("pass", F.lit("formatting")).select(*MATCH))
    both = exact.unionByName(broken)
    if mine.filter("style IS NOT NULL").isEmpty():
        return both
    left = _open(mine.select("commit_id", "position", "path", "sign", "style").filter("style IS NOT NULL"), both, with_main=True)
    return both.unionByName(style_matches(commits, left, theirs, both))


def fallback_minimum(lines_total: int, norms: int) -> int:
    """Lines that a file must match at least: ten, or all of two to nine in a file of under ten lines."""
    return norms if 2 <= norms <= 9 and lines_total < 10 else 10


class _Held:
    """What messages of a sliding window hold of one text: how often each conversation has it, by alias of its path and, under None, at all."""

    def __init__(self):
        self.written: deque[tuple] = deque()
        self.rows: dict[tuple, dict[str, int]] = {}
        self.tables: dict[str | None, dict[str, int]] = {}
        self.agents: dict[str, str] = {}
        self.paths: dict[str, set[str]] = {}

    def _count(self, path: str, conversation: str, n: int) -> None:
        for alias in (None, *aliases_of(path)):
            table = self.tables.setdefault(alias, {})
            if (left := table.get(conversation, 0) + n) > 0:
                table[conversation] = left
            elif table.pop(conversation, 0) and not table:
                del self.tables[alias]

    def add(self, time: int, path: str, conversation: str, agent: str) -> None:
        self.written.append((time, path, conversation, agent))
        of = self.rows.setdefault((path, conversation), {})
        of[agent] = of.get(agent, 0) + 1
        self.paths.setdefault(conversation, set()).add(path)
        self.agents[conversation] = min(self.agents.get(conversation, agent), agent)
        self._count(path, conversation, 1)

    def forget(self, until: int) -> None:
        while self.written and self.written[0][0] <= until:
            _, path, conversation, agent = self.written.popleft()
            of = self.rows[path, conversation]
            of[agent] -= 1
            self._count(path, conversation, -1)
            if not of[agent]:
                del of[agent]
                if not of:
                    del self.rows[path, conversation]
                    self.paths[conversation].discard(path)
                self._name(conversation)

    def _name(self, conversation: str, without: set[str] = frozenset()) -> None:
        found = [min(self.rows[path, conversation]) for path in self.paths[conversation] - without]
        self.agents.pop(conversation, None)
        if found:
            self.agents[conversation] = min(found)

    def left(self, used: dict[tuple, int]) -> _Held:
        """The same, less lines (path, conversation) that are used up, to be read only."""
        if not used:
            return self
        out = _Held()
        out.rows, out.paths, out.agents, out.tables = self.rows, self.paths, dict(self.agents), {alias: dict(t) for alias, t in self.tables.items()}
        gone: dict[str, set[str]] = defaultdict(set)
        for (path, conversation), n in used.items():
            held = sum(self.rows.get((path, conversation), {}).values())
            if held:
                out._count(path, conversation, -min(n, held))
                if n >= held:
                    gone[conversation].add(path)
        for conversation, paths in gone.items():
            out._name(conversation, paths)
        return out

    def best(self, aliases: list[str], lines: int, preferred: set[str]) -> list[tuple]:
        """(alias or None, [(conversation, n)]): of each table what `lines` lines may come to take, as many conversations with most and the preferred ones."""
        out = []
        for alias in (None, *aliases):
            if table := self.tables.get(alias):
                ranked = sorted(table.items(), key=lambda kv: (-kv[1], kv[0])) if len(table) > 1 else list(table.items())
                out.append((alias, ranked[:lines] + [kv for kv in ranked[lines:] if kv[0] in preferred]))
        return out


def _offers(text: tuple, events: Iterator[tuple]) -> Iterator[tuple]:
    """(commit_id, offer) for each commit that has lines of a text open and messages in its window that hold it.

    events by time: messages (commit_id null) with path, conversation and agent; then of
    each commit, at the end of its window, its open lines (n_open of their file not
    null) and the message lines that it has used up already. An offer is JSON: its
    files [path, lines, n_open, lines_total, preferred], how many lines in all, the
    tables of _Held.best, and the agent of each conversation.
    """
    held = _Held()
    for (commit, time), rows in groupby(events, key=lambda e: (e[0], e[1] if e[0] is not None else None)):
        if commit is None:
            for _, at, path, conversation, agent, *_ in rows:
                held.add(at, path, conversation, agent)
            continue
        held.forget(time - WINDOW)
        files: dict[str, list] = {}
        used: dict[tuple, int] = defaultdict(int)
        for _, _, path, conversation, _, n_open, lines_total in rows:
            if n_open is None:
                used[path, conversation] += 1
            else:
                files.setdefault(path, [path, 0, n_open, lines_total, conversation])[1] += 1
        now = held.left(used) if files and held.written else held
        if files and (n := sum(now.tables.get(None, {}).values())):
            lines = sum(f[1] for f in files.values())
            aliases = list(dict.fromkeys(alias for path in files for alias in aliases_of(path)))
            yield commit, json.dumps([list(files.values()), min(n, lines), now.best(aliases, lines, {f[4] for f in files.values()}), list(now.agents.items())])


class _Supply:
    """What messages of the window still hold of one text: how often, and in which conversations, by alias of path and at all."""

    def __init__(self, left: int, tables: list):
        self.left = left
        self.tables = {alias: dict(table) for alias, table in tables}

    @staticmethod
    def _most(counts: dict[str, int] | None) -> str | None:
        return min((k for k in counts if counts[k] > 0), key=lambda k: (-counts[k], k), default=None) if counts else None

    def take(self, aliases: list[str], preferred: str | None) -> tuple[str | None, list[dict[str, int]]]:
        """The conversation that gave a line of this text, and the counts it was taken from: the file's own
        conversation first, then by the longest path that has one, then the conversation with most."""
        whole = self.tables.get(None, {})
        tables = [t for alias in aliases if (t := self.tables.get(alias))]
        found, table = None, None
        if preferred is not None:
            table = next((t for t in [*tables, whole] if t.get(preferred, 0) > 0), None)
            found = preferred if table is not None else None
        if found is None:
            table = next((t for t in [*tables, whole] if self._most(t) is not None), None)
            found = self._most(table)
        if found is None:
            return None, []
        taken = [table] if table is whole or whole.get(found, 0) <= 0 else [table, whole]
        for t in taken:
            t[found] -= 1
        return found, taken


def _fallback_commit(commit_id: str, offers: list[str]) -> list[tuple]:
    """Files in order of path; a file that doesn't reach its minimum gives back what it took. offers: of its texts, as _offers gives them."""
    files: dict[str, list] = {}
    agents: dict[str, str] = {}
    for of_files, left, tables, named in map(json.loads, offers):
        supply = _Supply(left, tables)
        for path, lines, n_open, lines_total, preferred in of_files:
            files.setdefault(path, [n_open, lines_total, preferred, []])[3].append((supply, lines))
        for conversation, agent in named:
            agents[conversation] = min(agents.get(conversation, agent), agent)
    out = []
    for path, (n_open, lines_total, preferred, texts) in sorted(files.items(), key=itemgetter(0)):
        minimum = fallback_minimum(lines_total, n_open)
        if sum(min(lines, supply.left) for supply, lines in texts) < minimum:
            continue
        aliases, found_lines = aliases_of(path), defaultdict(int)
        for supply, lines in texts:
            for _ in range(min(lines, supply.left)):
                supply.left -= 1
                found_lines[supply.take(aliases, preferred)[0]] += 1
        out += [(commit_id, path, found, agents[found], n) for found, n in found_lines.items() if found is not None]
    return out


def norm_index(message_tokens: DataFrame) -> DataFrame:
    """(norm, day, path, conversation_id, agent, n): how often messages of a day hold a text, by path and conversation."""
    return message_tokens.groupBy("norm", F.floor(F.col("timestamp") / DAY).alias("day"), "path", "conversation_id").agg(F.min("agent").alias("agent"), F.count(F.lit(1)).alias("n"))


def norm_supply(commits: DataFrame, wanted: DataFrame, message_tokens: DataFrame, matched: DataFrame) -> DataFrame:
    """(commit_id, norm, path, conversation_id, agent, n): for the texts wanted (commit_id, norm), how often messages in the commit's window hold them, less what `matched` has used.

    A running count over time of each text, path, conversation and agent is read off at
    both ends of the window, in each bin that the window touches. So the work goes with
    the messages and with what comes out, not with how often a text was written.
    """
    keys = ["commit_id", "norm", "path", "conversation_id"]
    lists = ["norm", "path", "conversation_id", "agent", "bin"]
    written = message_tokens.groupBy("norm", "path", "conversation_id", "agent", "timestamp", _bin()).agg(F.count(F.lit(1)).alias("n"))
    low, high, start = F.col("authored_ms") - LOOK_BACK, F.col("authored_ms") + LOOK_AHEAD, F.col("bin") * LOOK_BACK
    ends = F.filter(F.array(F.struct(low.alias("time"), F.lit(-1).alias("weight")), F.struct(F.least(high, start + LOOK_BACK - 1).alias("time"), F.lit(1).alias("weight"))), lambda e: e["time"] >= start)
    asked = _with_bins(wanted, commits).join(written.select(lists).distinct(), ["norm", "bin"]).select("commit_id", *lists, F.inline(ends))
    both = written.select(*lists, F.col("timestamp").alias("time"), "n").unionByName(asked, allowMissingColumns=True)
    so_far = W.partitionBy(*lists).orderBy("time", F.asc_nulls_first("commit_id")).rowsBetween(W.unboundedPreceding, 0)  # messages before the ends at their time
    counts = both.withColumn("held", F.coalesce(F.sum("n").over(so_far), F.lit(0))).filter("weight IS NOT NULL")
    counts = counts.groupBy(*keys, "agent").agg(F.sum(F.col("held") * F.col("weight")).alias("n")).filter("n > 0")
    if "used" in matched.columns:
        taken = matched.select("commit_id", "message_id", F.explode("used").alias("position")).join(message_tokens.select("message_id", "position", "norm", "path", "conversation_id"), ["message_id", "position"])
        counts = counts.unionByName(taken.select(*keys, F.lit(None).cast("string").alias("agent"), F.lit(-1).cast("long").alias("n")).join(wanted, ["commit_id", "norm"], "left_semi"))
    return counts.groupBy(*keys).agg(F.min("agent").alias("agent"), F.sum("n").alias("n")).filter("n > 0")


def fallback_lines(commits: DataFrame, commit_tokens: DataFrame, matched: DataFrame, message_tokens: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(commit_id, path, conversation_id, agent, lines): unmatched lines whose text alone was written by agents in the window.

    A text serves as often as messages hold it and the other passes have left it. A
    file counts only with enough such lines (fallback_minimum); one that falls short
    leaves them to the files after it, in order of path. Lines go to the file's
    dominant conversation if it has the text, else by path, else to the conversation
    with most of it, ties by id. files: (commit_id, path, ignored, moved, lines_total),
    of which ignored and moved ones are left out; without it all count, by their tokens.

    Texts are known by their digest. Rows of one text and span of time are read in
    order of time, messages go in and out of the window as it slides, and a commit that
    has the text open gets no more of its counts than its lines can come to take. Only
    that goes on to the fold of the commit.
    """
    blank = {"path": "string", "position": "int", "text": "binary", "lines_total": "long", "preferred": "string", "is_line": "boolean", "is_used": "boolean"}

    def part(rows: DataFrame, **given) -> DataFrame:
        return rows.select("commit_id", *[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in blank.items()])

    path, place, true = F.col("path"), F.col("position"), F.lit(True)
    main = dominant_conversation(matched, "commit_id", "path")
    rows = part(commit_tokens.filter("attributable"), path=path, position=place, text=_digest("norm"), is_line=true)
    rows = rows.unionByName(part(matched, position=place, is_used=true)).unionByName(part(main, path=path, preferred=F.col("conversation_id")))
    if files is not None:
        rows = rows.unionByName(part(files.filter("NOT ignored AND NOT moved"), path=path, lines_total=F.col("lines_total")))
    of_file, of_line = W.partitionBy("commit_id", "path"), W.partitionBy("commit_id", "position")
    rows = rows.repartition("commit_id").withColumn("open", F.col("is_line") & F.max("is_used").over(of_line).isNull())
    total = F.count_if("is_line").over(of_file) if files is None else F.max("lines_total").over(of_file)
    rows = rows.withColumns({"n_open": F.count_if("open").over(of_file), "total": total, "main": F.max("preferred").over(of_file)})
    times = _times(commits)
    lines = rows.filter("open AND total IS NOT NULL AND path IS NOT NULL").join(times, "commit_id")

    lines = lines.select("text", *_ends(), "commit_id", "path", F.col("main").alias("conversation_id"), F.lit(None).cast("string").alias("agent"), "n_open", F.col("total").alias("lines_total"))
    events = lines.unionByName(_serving(message_tokens.select(_digest("norm").alias("text"), "path", "conversation_id", "agent", "timestamp")).withColumnRenamed("timestamp", "time"), allowMissingColumns=True)
    if "used" in matched.columns:
        used = matched.select("commit_id", "message_id", F.explode("used").alias("position"))
        sources = message_tokens.select("message_id", place.cast("int").alias("position"), _digest("norm").alias("text"), "path", "conversation_id")
        used = used.join(sources, ["message_id", "position"]).join(times, "commit_id")
        events = events.unionByName(used.select("text", *_ends(), "commit_id", "path", "conversation_id"), allowMissingColumns=True)

    columns = ["commit_id", "time", "path", "conversation_id", "agent", "n_open", "lines_total"]
    none = {"message_id": F.lit(None).cast("string"), "position": F.lit(None).cast("int")}
    offers = _sweep_texts(events.withColumns(none), columns, _offers, "commit_id string, offer string")
    return fold_groups(offers, ["commit_id"], [], ["offer"], lambda key, found: _fallback_commit(key[0], [offer for (offer,) in found]), "commit_id string, path string, conversation_id string, agent string, lines long")


def _digest(norm: str):
    return F.unhex(F.md5(norm))


def dominant_conversation(matched: DataFrame, *keys: str) -> DataFrame:
    """Per key the conversation with most matched lines, ties by the least id."""
    counts = matched.groupBy(*keys, "conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("agent").alias("agent"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "conversation_id", "agent")).alias("best"))
    return best.select(*keys, F.col("best.conversation_id").alias("conversation_id"), F.col("best.agent").alias("agent"), (-F.col("best.n")).alias("n"))


def deleted_files(files: DataFrame, matched: DataFrame) -> DataFrame:
    """(commit_id, path, agent, lines): files that were only removed from, without any match, go to the commit's dominant conversation.

    files: (commit_id, path, added, removed).
    """
    pure = files.filter("added = 0 AND removed > 0").join(matched.select("commit_id", "path").distinct(), ["commit_id", "path"], "left_anti")
    return pure.join(dominant_conversation(matched, "commit_id").select("commit_id", "agent"), "commit_id").select("commit_id", "path", "agent", F.col("removed").alias("lines"))


def attribute(commits: DataFrame, commit_tokens: DataFrame, message_tokens: DataFrame) -> DataFrame:
    """(commit_id, path, agent, lines, percent): lines of each file by agent, from all passes."""
    matched = match_lines(commits, commit_tokens, message_tokens)
    return lines_by_agent(commit_tokens, matched, fallback_lines(commits, commit_tokens, matched, message_tokens))


def lines_by_agent(commit_tokens: DataFrame, matched: DataFrame, fallback: DataFrame) -> DataFrame:
    """(commit_id, path, agent, lines, percent) from what the passes have found."""
    files = commit_tokens.groupBy("commit_id", "path").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"), F.count_if("attributable").alias("total"))
    met = matched.select("commit_id", "path", "conversation_id", "agent").unionByName(fallback.select("commit_id", "path", "conversation_id", "agent"))
    gone = deleted_files(files, met)
    lines = matched.groupBy("commit_id", "path", "agent").agg(F.count(F.lit(1)).alias("lines")).unionByName(fallback.select("commit_id", "path", "agent", "lines")).unionByName(gone)
    out = lines.groupBy("commit_id", "path", "agent").agg(F.sum("lines").alias("lines")).join(files.select("commit_id", "path", "total"), ["commit_id", "path"])
    return out.select("commit_id", "path", "agent", "lines", percentage(F.col("lines"), F.col("total")).alias("percent"))


def links(matched: DataFrame, fallback: DataFrame) -> DataFrame:
    """Distinct (commit_id, conversation_id); a fallback links only with two lines or more in a file."""
    return matched.select("commit_id", "conversation_id").union(fallback.filter("lines >= 2").select("commit_id", "conversation_id")).distinct()


def to_recompute(commits: DataFrame, version: int, cutoff: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Commits to attribute again: of an old version, after a cutoff less the window, or named."""
    out = commits.filter(F.col("coverage_version") < version)
    if cutoff is not None:
        out = out.unionByName(commits.filter(F.col("authored_at") * 1000 >= cutoff - LOOK_AHEAD))
    if ids is not None:
        out = out.unionByName(commits.join(ids, "id", "left_semi"))
    return out.dropDuplicates(["id"])


def to_recompute_for_visibility(commits: DataFrame, diffs: DataFrame, linked: DataFrame, hidden: bool) -> DataFrame:
    """Commits to attribute again when conversations are hidden or shown: within the window of their diffs; when hiding, only linked ones.

    diffs: (project_id, conversation_id, timestamp); linked: (commit_id, conversation_id).
    Conversations' spans and commits meet in bins of LOOK_BACK, so the window is part of the equi join.
    """
    spans = diffs.groupBy("project_id", "conversation_id").agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    ms = F.col("authored_at") * 1000
    low, high = F.col("low") - LOOK_BACK, F.col("high") + LOOK_AHEAD
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(low / LOOK_BACK), F.floor(high / LOOK_BACK))))
    near = commits.withColumn("__bin", F.floor(ms / LOOK_BACK)).join(binned, ["project_id", "__bin"]).filter((ms >= low) & (ms <= high))
    if hidden:
        near = near.join(linked.select(F.col("commit_id").alias("id"), "conversation_id"), ["id", "conversation_id"], "left_semi")
    return near.select(commits.columns).dropDuplicates(["id"])


def to_recompute_for_patterns(commits: DataFrame, patterns: list[str]) -> DataFrame:
    """Commits whose diffs name a file that meets a changed glob."""
    return commits.filter(touches_patterns(F.col("diff_content"), patterns)) if patterns else commits.limit(0)

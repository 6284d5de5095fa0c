"""The graph of commits and their parents: what a head has that another hasn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def reach(edges: DataFrame, doublings: int = 3) -> DataFrame:
    """(commit, ancestor): ancestors up to 2 ** doublings steps away, from edges (commit, parent); each doubling is a join of the table with itself."""
    near = edges.filter("commit IS NOT NULL AND parent IS NOT NULL").select("commit", F.col("parent").alias("ancestor")).distinct()
    for _ in range(doublings):
        on = near.select(F.col("commit").alias("ancestor"), F.col("ancestor").alias("further"))
        near = near.union(near.join(on, "ancestor").select("commit", F.col("further").alias("ancestor"))).distinct()
    return near


def commits_between(edges: DataFrame, numbers: DataFrame, moves: DataFrame, doublings: int = 3) -> DataFrame:
    """(move, commit): for each move (move, before, head) the commits that head reaches and before doesn't; without before, all that head reaches.

    edges: (commit, parent), several for a merge. numbers: (commit, number), any
    numbering in which a parent's is smaller, such as the order of ingestion. Both ends
    send their mark to their ancestors, 2 ** doublings generations a round, all moves
    at once. A commit that before reaches is marked on only while a commit of larger
    reach than it is open below it: if all commits that only head has reached so far
    have larger numbers, none of them can be its ancestor. Commits that only head has
    reached wait for those of before that lie above the lowest of them; what is left
    then is out of before's reach for good, so head's marks never run ahead of before's
    by more than a round. So a move of a few commits in a long history stays in their
    neighbourhood, and rounds go with the length of the range, not of the history.
    Commits without a number or edges (a shallow boundary) end a path.
    """
    near = stored(reach(edges, doublings))
    rows = numbers.select("commit", "number")
    head = moves.filter("head IS NOT NULL").select("move", F.col("head").alias("commit"), F.lit(1).alias("ours"), F.lit(0).alias("theirs"))
    before = moves.filter("before IS NOT NULL").select("move", F.col("before").alias("commit"), F.lit(0).alias("ours"), F.lit(1).alias("theirs"))

    def marks(found: DataFrame) -> DataFrame:
        return found.groupBy("move", "commit").agg(F.max("ours").alias("ours"), F.max("theirs").alias("theirs"))

    only_ours = (F.col("ours") == 1) & (F.col("theirs") == 0)
    state = stored(marks(head.union(before)).join(rows, "commit", "left").select("move", "commit", "ours", "theirs", "number", F.lit(False).alias("sent")))
    while True:
        lowest = state.filter(only_ours).groupBy("move").agg(F.min("number").alias("lowest"))
        due = ~F.col("sent") & ~only_ours & F.coalesce(F.col("number") > F.col("lowest"), F.col("lowest").isNotNull())
        open_ = state.join(lowest, "move", "left").withColumn("due", due)
        waits = open_.groupBy("move").agg(F.max("due").alias("waits"))
        open_ = open_.join(waits, "move").withColumn("go", F.col("due") | (~F.col("sent") & only_ours & ~F.col("waits")))
        open_ = stored(open_.drop("lowest", "due", "waits"))
        if not open_.filter("go").limit(1).count():
            return state.filter(only_ours).select("move", "commit")
        reached = marks(open_.filter("go").join(near, "commit").select("move", F.col("ancestor").alias("commit"), "ours", "theirs"))
        known = open_.select("move", "commit", F.col("ours").alias("had_ours"), F.col("theirs").alias("had_theirs"), "number", (F.col("sent") | F.col("go")).alias("done"))
        both = known.join(reached, ["move", "commit"], "full").join(rows.withColumnRenamed("number", "new_number"), "commit", "left")
        ours, theirs = F.greatest("ours", "had_ours"), F.greatest("theirs", "had_theirs")
        same = (ours == F.col("had_ours")) & (theirs == F.col("had_theirs"))
        state = stored(both.select("move", "commit", ours.alias("ours"), theirs.alias("theirs"), F.coalesce("number", "new_number").alias("number"), F.coalesce(F.col("done") & same, F.lit(False)).alias("sent")))

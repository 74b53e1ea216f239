"""Reading a workspace: repositories, inventory with git states, contents, event logs.

Trees are listed by tasks, round by round: each task walks the folders it gets up to a number of entries and hands the rest on,
so that a small workspace takes one round and a large one spreads over the executors. Contents are read by Spark's binary
file source, in parallel, and only for the columns a plan asks for. The tree must be mounted wherever tasks run.
"""

from __future__ import annotations

import os
import subprocess
import sys
from collections import deque
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from functools import reduce
from itertools import islice
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths as p
from lodegraph.model import BOUNDARIES, EVENTS
from lodegraph.session import cut, ship

Probe = Callable[[str], dict[str, str]]
ROOT_VARIABLE = "CAMP_ROOT"
LISTED_AT_ONCE = 20_000  #: entries that a task lists below one folder before it hands on what is left


def find_root(start: str = ".") -> str:
    """The workspace root: the one the environment names, else the nearest folder upward that holds ``.campaign``."""
    if named := os.environ.get(ROOT_VARIABLE):
        return os.path.realpath(named)
    at = Path(start).resolve()
    for p in (at, *at.parents):
        if (p / ".campaign").is_dir():
            return str(p)
    raise FileNotFoundError(f"no workspace above {at}")


def is_repository(folder: str) -> bool:
    """Whether ``.git`` in a folder is a directory, or a file that points to one."""
    marker = os.path.join(folder, ".git")
    if os.path.isdir(marker):
        return True
    try:
        with open(marker, encoding="utf-8", errors="replace") as f:
            return f.read(7) == "gitdir:"
    except OSError:
        return False


def submodule_paths(root: str) -> set[str]:
    """The ``path =`` values of ``.gitmodules``."""
    try:
        lines = Path(root, ".gitmodules").read_text(encoding="utf-8", errors="replace").splitlines()
    except OSError:
        return set()
    return {v.strip() for k, eq, v in (x.partition("=") for x in lines) if eq and k.strip() == "path" and v.strip()}


def tree(spark: SparkSession, root: str, at_once: int = LISTED_AT_ONCE) -> DataFrame:
    """Everything below a folder but ``.git``: path, owner (the repository it lies in, else the root), repo, is_dir, size, mtime_ns.

    repo marks the folder of a repository that lies in no other one. Links to folders are listed, not followed.
    """
    ship(spark)
    root = os.path.realpath(root)

    def walk(folder: str, owner: str) -> Iterator[tuple]:
        todo, seen = deque([(folder, owner)]), 0
        while todo and seen < at_once:
            here, owner = todo.popleft()
            try:
                found = sorted(os.scandir(here), key=lambda x: x.name)
            except OSError:
                continue
            for x in found:
                if x.name == ".git":
                    continue
                try:
                    info, is_dir = x.stat(), x.is_dir()
                except OSError:
                    continue
                inside = is_dir and not x.is_symlink()
                repo = inside and owner == root and is_repository(x.path)
                seen += 1
                yield x.path, owner, repo, is_dir, info.st_size, info.st_mtime_ns, False
                if inside:
                    todo.append((x.path, x.path if repo else owner))
        for path, owner in todo:
            yield path, owner, False, True, 0, 0, True

    def run(batches):
        import pandas as pd

        for batch in batches:
            for folder, owner in zip(batch["path"], batch["owner"]):
                rows = walk(folder, owner)
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=["path", "owner", "repo", "is_dir", "size", "mtime_ns", "pending"])

    parts, frontier = [], spark.createDataFrame([(root, root)], "path string, owner string")
    while True:
        listed = cut(frontier.mapInPandas(run, "path string, owner string, repo boolean, is_dir boolean, size bigint, mtime_ns bigint, pending boolean"))
        parts.append(listed.where("not pending").drop("pending"))
        left = listed.where("pending").select("path", "owner")
        if not (n := left.count()):
            return reduce(DataFrame.unionByName, parts)
        frontier = left.repartition(min(n, spark.sparkContext.defaultParallelism * 4), "path")


def _below(path: str, folder: str) -> Column:
    return F.expr(f"substring({path}, {len(folder) + 2})")


def boundaries(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """The root and every repository below it; nothing inside a repository is looked at further. ``listed`` is the :func:`tree`."""
    root = os.path.realpath(root)
    known = spark.createDataFrame([(x,) for x in sorted(submodule_paths(root))], "rel_path string").withColumn("_sub", F.lit(True))
    found = (tree(spark, root) if listed is None else listed).where("repo").select(F.col("path").alias("abs_path"), _below("path", root).alias("rel_path"))
    repos = found.join(known, "rel_path", "left").select("abs_path", "rel_path", F.lit(False).alias("is_root"), F.coalesce("_sub", F.lit(False)).alias("is_submodule"), F.concat("abs_path", F.lit("/.git")).alias("git_dir"))
    own = spark.createDataFrame([(root, ".", True, False, os.path.join(root, ".git") if is_repository(root) else "")], BOUNDARIES)
    return own.unionByName(repos)


def git_states(repo: str) -> dict[str, str]:
    """rel_to_repo -> tracked, untracked or ignored; nothing where there is no repository."""
    out: dict[str, str] = {}
    asks = {"tracked": ["-c"], "untracked": ["-o", "--exclude-standard"], "ignored": ["-o", "--ignored", "--exclude-standard"]}
    for state, flags in asks.items():
        done = subprocess.run(["git", "-C", repo, "ls-files", "-z", *flags], capture_output=True, check=False)
        if done.returncode:
            return {}
        out |= {p.decode("utf-8", "surrogateescape"): state for p in done.stdout.split(b"\0") if p}
    return out


def states(repos: DataFrame, probe: Probe = git_states) -> DataFrame:
    """repo, inner, state of the files that a probe knows of repositories (one column ``repo``); each is asked in a task."""
    spark = repos.sparkSession
    ship(spark)
    module = sys.modules[probe.__module__]
    foreign = not probe.__module__.startswith("lodegraph.")
    if foreign:  # a caller's function goes by value, its module need not be there
        cloudpickle.register_pickle_by_value(module)
    try:
        packed = cloudpickle.dumps(probe)
    finally:
        if foreign:
            cloudpickle.unregister_pickle_by_value(module)

    def run(batches):
        import pickle

        import pandas as pd

        ask = pickle.loads(packed)
        for batch in batches:
            for repo in batch["repo"]:
                rows = iter(ask(repo).items())
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame([(repo, k, v) for k, v in some], columns=["repo", "inner", "state"])

    return repos.repartition("repo").mapInPandas(run, "repo string, inner string, state string")


def inventory(spark: SparkSession, root: str, with_ignored: bool = False, probe: Probe = git_states, skip: tuple[str, ...] = (), listed: DataFrame | None = None) -> DataFrame:
    """Every file and folder of the workspace with its repository and git state (``model.ENTRIES``), to be ordered by rel_path.

    Files no probe knows are ``unknown``, as folders are. Ignored files, and folders that hold nothing else, are left out
    unless asked for. ``skip`` has relative paths to leave out, such as the store's own. ``listed`` is the :func:`tree`.
    """
    root = os.path.realpath(root)
    listed = tree(spark, root) if listed is None else listed
    repos = listed.where("repo").select(F.col("path").alias("repo")).union(spark.createDataFrame([(root,)], "repo string"))
    known = cut(states(repos, probe))
    seen = known.select("repo", F.explode(p.ancestors(F.col("inner"))).alias("folder"), (F.col("state") == "ignored").alias("gone"))
    lost = cut(seen.groupBy("repo", "folder").agg(F.bool_and("gone").alias("gone")).where("gone").select("repo", "folder"))
    outer = _below("path", root)
    rows = listed.where("not repo").select("*", outer.alias("rel_path"), F.expr("substring(path, length(owner) + 2)").alias("inner"))
    for x in skip:
        rows = rows.where((F.col("rel_path") != x) & ~F.col("rel_path").startswith(x + "/"))
    dirs = lost.select(F.col("repo").alias("owner"), F.col("folder").alias("inner"), F.lit(True).alias("lost"))
    files = known.select(F.col("repo").alias("owner"), "inner", "state")
    rows = rows.join(files, ["owner", "inner"], "left").join(dirs, ["owner", "inner"], "left")
    ignored = F.when(F.col("is_dir"), F.coalesce("lost", F.lit(False))).otherwise(F.coalesce(F.col("state") == "ignored", F.lit(False)))
    rows = rows.withColumn("is_ignored", ignored)
    if not with_ignored and not lost.isEmpty():
        above = rows.select("owner", "inner", F.explode(p.ancestors(F.col("inner"))).alias("folder"))
        inside = above.join(lost.withColumnRenamed("repo", "owner"), ["owner", "folder"], "left_semi").select("owner", "inner").distinct()
        rows = rows.join(inside, ["owner", "inner"], "left_anti")
    if not with_ignored:
        rows = rows.where("not is_ignored")
    name = p.basename(F.col("rel_path"))
    ext = F.when(F.col("is_dir") | ~F.contains(name, F.lit(".")), "").otherwise(F.lower(F.substring_index(name, ".", -1)))
    return rows.select(
        F.col("path").alias("abs_path"), "rel_path", F.col("owner").alias("repo_root"), F.col("inner").alias("rel_to_repo"), F.when(F.col("is_dir"), "unknown").otherwise(F.coalesce("state", F.lit("unknown"))).alias("git_state"),
        "is_ignored", "is_dir", ext.alias("extension"), p.depth(F.col("rel_path")).cast("int").alias("path_depth"), "size", "mtime_ns",
    )


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """rel_path, content (bytes), length, modified of the files below a folder that match a glob.

    Spark's file source passes over hidden names; hidden folders are given to it by name, hidden files are read apart.
    """
    base = os.path.realpath(root)
    folders, files = [base], []
    for folder, names, leaves in os.walk(base):
        names[:] = [n for n in names if n != ".git"]
        folders += [os.path.join(folder, n) for n in names if n[0] in "._"]
        files += [os.path.join(folder, n) for n in leaves if n[0] in "._" and n != ".git" and fnmatch(n, pattern)]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folders)
    name = F.expr(f"substring(url_decode(replace(path, '+', '%2B')), {len('file:' + base) + 2})")
    seen = read.select(name.alias("rel_path"), "content", "length", F.col("modificationTime").alias("modified"))
    if not files:
        return seen

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open(path, "rb") as f:
                    rows.append((path[len(base) + 1 :], f.read(), os.path.getsize(path), pd.Timestamp(int(os.path.getmtime(path) * 1e6), unit="us")))
            yield pd.DataFrame(rows, columns=["rel_path", "content", "length", "modified"])

    ship(spark)
    hidden = spark.createDataFrame([(x,) for x in files], "path string").mapInPandas(run, "rel_path string, content binary, length bigint, modified timestamp")
    return seen.unionByName(hidden)


def texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """rel_path, text of UTF-8 files; bytes that aren't become the replacement character."""
    return contents(spark, root, pattern).select("rel_path", F.col("content").cast("string").alias("text"))


def events(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Events of the logs below ``.campaign/events``, and the lines that aren't events."""
    path = f"{os.path.realpath(root)}/.campaign/events"
    schema = f"{EVENTS}, _bad string"
    if not os.path.isdir(path):
        none = spark.createDataFrame([], schema)
        return none.drop("_bad"), none.select("_bad")
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    read = cut(read)  # the column of unread lines can't be asked for by itself otherwise
    return read.where("_bad is null and id is not null").drop("_bad"), read.where("_bad is not null").select("_bad")

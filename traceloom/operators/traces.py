"""Trace lines to nested tables (P1-P33). Input: ``file``, ``line_no``, ``line``; a file's lines stay together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.ordering import last_wins

# fixed values: markers and kinds of the trace format
BLOCK_TYPES = ("Vernac", "Constr", "Type", "ProofState")
KINDS = ("Definition", "Proof", "Assumption", "Inductive", "Fixpoint", "CoFixpoint", "Instance", "Context", "Ltac", "TacticNotation", "Primitive", "Arguments")
SECTIONS = {"original": "Original:", "pure": "pure constr:", "constr": "constr:", "processed": "processed:"}
USELESS_ERRORS = (
    "Compiled library", "Cannot find a physical path bound to logical path matching suffix", "makes inconsistent assumptions", "error loading shared library:",
    "File not found", "Unable to locate library", "Error: Native compiler exited", "Error: Unknown interpretation for notation",
    "Error: This command does not support this attribute", "cmxs", "Uncaught exception Not_found",
)
STARTS = ("Axiom", "Definition", "Fixpoint", "Lemma", "Theorem", "Instance", "Corollary", "Inductive", "Variable", "Parameter", "Notation", "Ltac")
DECLARATIONS, BINDER = ("prf", "var", "def"), "binder"
NO_PATH = "Cannot find a physical path bound to logical path matching suffix"


_MARK = re.compile(rf"({'|'.join(BLOCK_TYPES)})\b")


def blocks(lines: DataFrame) -> DataFrame:
    """File, block, type, kind_word, first_line, finished, lines (array of texts without the marks).

    Texts are trimmed and blank lines dropped. A block runs from a line that starts with a block type and
    says Begin to the End of that type. Within a ProofState no block opens, and only an End with its name
    closes it. Lines outside blocks are dropped; a block without an end runs to the next one and is unfinished.

    A file's lines are sorted once and pass through in order; what is held is one block, however long the file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "block", "type", "kind_word", "first_line", "finished", "lines"]
        file, block, kind, word, first, held, done = None, 0, "", "", 0, [], []
        for batch in batches:
            for of, at, text in zip(batch["file"].tolist(), batch["line_no"].tolist(), batch["line"].tolist()):
                if of != file:
                    if kind:
                        done.append((file, block, kind, word, first, False, held))
                    file, block, kind = of, 0, ""
                mark = _MARK.match(text)
                if mark and "Begin" in text and kind != "ProofState":
                    if kind:
                        done.append((file, block, kind, word, first, False, held))
                    block, kind, word, first, held = block + 1, mark[1], text.rpartition(" ")[2], at, []
                elif mark and mark[1] == kind and "End" in text and (kind != "ProofState" or text.rpartition(" ")[2] == word):
                    done.append((file, block, kind, word, first, True, held))
                    kind, held = "", []
                elif kind:
                    held.append(text)
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if kind:
            yield pd.DataFrame([(file, block, kind, word, first, False, held)], columns=names)

    kinds = dict(lines.dtypes)
    ordered = lines.select("file", "line_no", F.trim("line").alias("line")).where("line != ''").repartition("file").sortWithinPartitions("file", "line_no")
    return ordered.mapInPandas(run, f"file {kinds['file']}, block long, type string, kind_word string, first_line {kinds['line_no']}, finished boolean, lines array<string>")


def known_kind(word: Column) -> Column:
    """Whether the last word of a header is a known kind; rows with others belong in quarantine."""
    return word.isin(*KINDS)


def surface_fields(blocks_: DataFrame) -> DataFrame:
    """Adds name (2nd word, 3rd after ``Let``) and content (text after the kind's keyword, lines joined by a blank)."""
    text = F.array_join("lines", " ")
    words = F.split(text, " ")
    let = F.get(words, 0) == "Let"
    after = F.when(let, F.concat(F.lit("Let "), F.get(words, 1))).otherwise(F.get(words, 0))
    return blocks_.withColumn("name", F.when(let, F.get(words, 2)).otherwise(F.get(words, 1))).withColumn(
        "content", F.trim(F.substr(text, F.length(after) + 1))
    )


def context_name(text: Column) -> Column:
    """P5: without a leading backquote, brackets around and exclamation marks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^`", ""), r"^[{(]|[})]$", ""), "!", "")


def tactic_definition(text: Column) -> tuple[Column, Column]:
    """Name and body of ``Name: n Body: b``; an error where there is no body."""
    name = F.regexp_extract(text, r"(?s)Name:\s*(\S+)", 1)
    body = F.regexp_extract(text, r"(?s)Body:\s*(.*)$", 1)
    return name, F.when(text.contains("Body:"), body).otherwise(F.raise_error(F.lit("a tactic definition has no body")).cast("string"))


def tactic_notation(text: Column) -> tuple[Column, Column]:
    """Name (cut at the first word of the local name, else at ``_``), content (local name before the body)."""
    name = F.regexp_extract(text, r"(?s)\bName:\s*(\S+)", 1)
    local = F.trim(F.regexp_extract(text, r"(?s)LocalName:\s*(.*?)\s*Body:", 1))
    first = F.split(local, " ")[0]
    cut = F.when((first != "") & name.contains(first), F.concat(F.call_function("substring_index", name, first, F.lit(1)), first)).otherwise(F.substring_index(name, "_", 1))
    return cut, F.concat_ws(" ", local, F.regexp_extract(text, r"(?s)Body:\s*(.*)$", 1))


def _sectioned(blocks_: DataFrame, heads: dict[str, str]) -> DataFrame:
    """Lines exploded with ``section`` (carried forward from the last head) and ``rest`` (text less the head)."""
    each = blocks_.select("file", "block", F.posexplode("lines").alias("at", "line"))
    head = F.lit(None).cast("string")
    rest = F.col("line")
    for name, mark in reversed(heads.items()):
        head = F.when(F.col("line").startswith(mark), F.lit(name)).otherwise(head)
        rest = F.when(F.col("line").startswith(mark), F.trim(F.substring(F.col("line"), len(mark) + 1, 2**30))).otherwise(rest)
    over = Window.partitionBy("file", "block").orderBy("at")
    return each.withColumn("_head", head).withColumn("section", F.last("_head", ignorenulls=True).over(over)).withColumn("rest", rest)


def internal_fields(blocks_: DataFrame) -> DataFrame:
    """File, block, name, content (lines after ``Type:``), body (lines after ``Body:``); both may be null."""
    lines = _sectioned(blocks_, {"name": "Name:", "content": "Type:", "body": "Body:"}).where("rest != ''")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "rest"))), lambda x: x["rest"])
    joined = lines.groupBy("file", "block", "section").agg(F.array_join(ordered, "\n").alias("text"))
    pick = lambda s: F.max(F.when(F.col("section") == s, F.col("text"))).alias(s)
    return joined.groupBy("file", "block").agg(pick("name"), pick("content"), pick("body"))


def term_fields(blocks_: DataFrame) -> DataFrame:
    """File, block, original, pure, constr, processed, variable. Lines without a head belong to the section before."""
    lines = _sectioned(blocks_, SECTIONS).where("section is not null")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "rest"))), lambda x: x["rest"])
    joined = lines.groupBy("file", "block", "section").agg(F.array_join(F.filter(ordered, lambda x: x != ""), " ").alias("text"))
    pick = lambda s: F.max(F.when(F.col("section") == s, F.col("text"))).alias(s)
    out = joined.groupBy("file", "block").agg(*(pick(s) for s in SECTIONS))
    return out.withColumn("variable", F.nullif(F.regexp_extract(F.coalesce("processed", F.lit("")), r"^Variable (\S+)", 1), F.lit("")))


def constructors(text: Column) -> Column:
    """P10: array of (name, type) between constructor marks, split at the first colon."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)@IND Constructors Begin\s*(.*?)\s*@IND Constructors End"), 1)
    return F.transform(
        found,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("name"),
            F.trim(F.regexp_replace(x, r"^[^:]*:>?", "")).alias("type"),
        ),
    )


def with_constructors(content: Column, found: Column) -> Column:
    """``parent | c1 : t1 | ...``."""
    return F.concat_ws(" | ", content, F.array_join(F.transform(found, lambda c: F.concat(c["name"], F.lit(" : "), c["type"])), " | "))


_BEGIN = re.compile(r"PS Begin of (\S+) <T>(.*?)</T>", re.DOTALL)
_END = re.compile(r"PS End of (\S+) <T>(.*?)</T>", re.DOTALL)
_NOTICE = re.compile(r"PS Notice.*<T>(.*?)</T>", re.DOTALL)


def _closings(lines: list[str]) -> dict[int, tuple[int, bool]]:
    """Of each line that begins a step and has an end: where that is, and whether it is a proper one. Steps of one tactic nest."""
    open_: dict[str, list[int]] = {}
    out = {}
    for at, line in enumerate(lines):
        if not line.startswith("PS "):
            continue
        if m := _BEGIN.match(line):
            open_.setdefault(m[2], []).append(at)
        elif (e := _END.match(line)) or (n := _NOTICE.match(line)):
            if begun := open_.get(e[2] if e else n[1]):
                out[begun.pop()] = (at, bool(e))
    return out


def _tree(lines: list[str], most: float) -> Iterator[tuple[str, int, str, int, int]]:
    """(path, depth, tactic, first, last) of an episode's steps, parents first."""
    closing = _closings(lines)
    todo = [(0, len(lines), 1, "")]
    while todo:
        k, hi, depth, prefix = todo.pop()
        found = []
        while k < hi:
            end, proper = closing.get(k, (hi, False))
            if end >= hi:  # no step begins here, or not one that ends at this level
                k += 1
                continue
            if proper:
                found.append((k, end, _BEGIN.match(lines[k])[2]))
            k = end + 1
        for i, (first, last, tactic) in enumerate(found, 1):
            path = f"{prefix}{i}/{len(found)}"
            yield path, depth, tactic, first, last
            if last > first + 1 and (depth < most or (most == 1 and ";" in tactic)):
                todo.append((first + 1, last, depth + 1, path + "-"))


def step_tree(episodes: DataFrame, most_depth: float = float("inf")) -> DataFrame:
    """Episode, path ("i/n" for each level, joined by "-"), depth, tactic, first, last (places in ``lines``).

    A step closes at the End with its tactic, counting steps of equal tactic between; a notice that names it
    closes it as abnormal and drops it. Siblings are numbered after that. ``episodes``: episode, lines. Nesting may be of
    any depth, and an episode's lines are gone over twice; as each path names all its levels, very deep steps have long paths.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["episode", "path", "depth", "tactic", "first", "last"]
        for batch in batches:
            out, size = [], 0
            for episode, lines in zip(batch["episode"], batch["lines"]):
                for step in _tree(list(lines), most_depth):
                    out.append((episode, *step))
                    size += len(step[0]) + 100
                    if size > 8 << 20:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return episodes.select("episode", "lines").mapInPandas(run, "episode string, path string, depth long, tactic string, first long, last long")


def step_fields(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds before_line (place of the last ``PS Before`` of that tactic) and n_after (how many ``PS After``).

    A machine step ``::x@`` keeps its part between the marks as the tactic.
    """
    lines = episodes.select("episode", F.posexplode("lines").alias("at", "line")).where(F.col("line").rlike("^PS (Before|After)"))
    named = lines.withColumn("_t", F.regexp_extract("line", r"(?s)<T>(.*?)</T>", 1))
    marks = named.select(F.col("episode").alias("_e"), "_t", "at", "line")
    own = (F.col("episode") == F.col("_e")) & (F.col("tactic") == F.col("_t")) & F.col("at").between(F.col("first"), F.col("last"))
    met = steps.join(marks, own, "left")
    hit = F.col("at").isNotNull()
    ml = F.regexp_extract("tactic", "::(.*?)@", 1)
    return met.groupBy("episode", "path", "depth", "tactic", "first", "last").agg(
        F.max(F.when(hit & F.col("line").startswith("PS Before"), F.col("at"))).cast("long").alias("before_line"),
        F.count_if(hit & F.col("line").startswith("PS After")).alias("n_after"),
    ).withColumn("tactic", F.when(ml != "", ml).otherwise(F.col("tactic")))


def state_fields(lines: Column) -> tuple[Column, Column]:
    """Hypothesis names in order, and the goal's text (``goalcompleted`` when the subgoal is done)."""
    text = F.array_join(lines, "\n")
    hyps = F.regexp_extract(text, r"(?s)PS Begin Hyps(.*?)PS End Hyps", 1)
    goal = F.regexp_extract(text, r"(?s)PS Begin Goal\s*Original: (.*?)(?:\n|$)", 1)
    done = text.contains("PS Current subgoal Completed")
    names = F.regexp_extract_all(hyps, F.lit(r"Name: (\S+)"), 1)
    return F.when(done, F.array().cast("array<string>")).otherwise(names), F.when(done, F.lit("goalcompleted")).otherwise(goal)


def author_parts(lines: DataFrame, begin: str = "TACTIC Begin", end: str = "TACTIC End") -> DataFrame:
    """Adds ``authored``: whether a line lies between the marks; the marks themselves go."""
    over = Window.partitionBy("file").orderBy("line_no")
    change = F.when(F.col("line").startswith(begin), 1).when(F.col("line").startswith(end), -1).otherwise(0)
    open_ = F.sum(change).over(over)
    return lines.withColumn("authored", open_ > 0).where(~F.col("line").startswith(begin) & ~F.col("line").startswith(end))


def path_key(path: Column) -> Column:
    """Place among siblings at each level, as numbers: sorting by it is pre-order."""
    return F.transform(F.split(path, "-"), lambda p: F.substring_index(p, "/", 1).cast("int"))


def parent_path(path: Column) -> Column:
    """The path less its last level; null at the top."""
    parts = F.split(path, "-")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-"))


def nested(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps with ``n_children``, steps whose parent is missing)."""
    with_parent = steps.withColumn("parent", parent_path(F.col("path")))
    keys = steps.select("episode", F.col("path").alias("parent"))
    orphans = with_parent.where("parent is not null").join(keys, ["episode", "parent"], "left_anti")
    children = with_parent.where("parent is not null").groupBy("episode", F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    return steps.join(children, ["episode", "path"], "left").fillna(0, ["n_children"]), orphans


def episode_facts(steps: DataFrame) -> DataFrame:
    """Episode, tactics (of the top level, in order), n (from ``i/n``), last (tactic of the last step)."""
    top = steps.where(~F.col("path").contains("-")).withColumn("_i", F.substring_index("path", "/", 1).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "tactic")))
    return top.groupBy("episode").agg(
        F.transform(ordered, lambda x: x["tactic"]).alias("tactics"),
        F.max(F.substring_index("path", "/", -1).cast("long")).alias("n"),
        F.max_by("tactic", "_i").alias("last"),
    )


def open_goals(results: Column) -> Column:
    """What is left open after ordered results. Each result: how many goals it leaves (0: completed).

    A stack of goals: more than one pushes them, none closes the innermost open goal, one changes nothing.
    The answer is the number of goals still open; below zero means more were closed than there were.
    """
    return F.aggregate(results, F.lit(1).cast("long"), lambda s, r: F.when(s < 1, s - F.when(r == 0, 1).otherwise(0)).otherwise(s + r - 1))


def assembled(surface: DataFrame, internal: DataFrame, types: DataFrame) -> DataFrame:
    """Definitions by name: the last internal row wins, its surface row and its types (a map) joined on.

    ``surface``: name, kind, content, ord. ``internal``: name, internal, ord. ``types``: parent, local, type.
    Primitive rows go; Ltac and TacticNotation rows come from the surface alone, by the name's last part.
    """
    scripted = F.col("kind").isin("Ltac", "TacticNotation")
    short = last_wins(surface.where(scripted).withColumn("name", F.element_at(F.split("name", r"\."), -1)), "name", [F.desc("ord")])
    outer = last_wins(surface.where(~scripted), "name", [F.desc("ord")])
    inner = last_wins(internal, "name", [F.desc("ord")])
    maps = types.groupBy(F.col("parent").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("local", "type"))).alias("types"))
    main = inner.select("name", "internal").join(outer.select("name", "kind", "content"), "name", "left").join(maps, "name", "left")
    main = main.where("kind is null or kind != 'Primitive'")
    return main.unionByName(short.select("name", F.lit("Ltac").alias("kind"), "content"), allowMissingColumns=True)


def gated(items: DataFrame, holdout: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """P20: rows of excluded keys go; ``steps_allowed`` is false for keys held out."""
    kept = items.join(excluded.select(key).distinct(), key, "left_anti")
    return kept.join(holdout.select(key).distinct().withColumn("_held", F.lit(True)), key, "left").withColumn("steps_allowed", F.col("_held").isNull()).drop("_held")


def trailing_run(rows: DataFrame, by: str, order: str, matches: Column) -> DataFrame:
    """The rows of each group after its last row that does not match."""
    after = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_miss", F.sum(F.when(matches, 0).otherwise(1)).over(after)).where("_miss = 0").drop("_miss")


def failed_files(lines: DataFrame, pattern: str = r"Error in file (\S+?):") -> DataFrame:
    """P22."""
    found = F.regexp_extract("line", pattern, 1)
    return lines.select(found.alias("failed")).where("failed != ''").distinct()


def useful_error(text: Column, patterns: tuple[str, ...] = USELESS_ERRORS) -> Column:
    """False where any of the fixed texts occurs."""
    return ~text.rlike("|".join(re.escape(p) for p in patterns))


def enclosing(rows: DataFrame, by: str, order: str, is_start: Column, name: Column) -> DataFrame:
    """Adds ``before`` and ``after``: names of the nearest start at or before the row, and at or after it."""
    at = F.when(is_start, name)
    up = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("before", F.last(at, ignorenulls=True).over(up)).withColumn("after", F.last(at, ignorenulls=True).over(down))


def start_name(line: Column, keywords: tuple[str, ...] = STARTS) -> Column:
    """The word after the first of ``keywords`` (in their order) that the line holds with a blank after it; null if none."""
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(line.contains(k + " "), F.substring_index(F.substr(line, F.locate(k + " ", line) + len(k) + 1), " ", 1)).otherwise(out)
    return out


def containing(needles: DataFrame, hays: DataFrame, anchor: int = 12) -> DataFrame:
    """Distinct (needle, hay) where the text ``hay`` holds the text ``needle``; empty and null ones are left out.

    The first letters of needles, ``anchor`` at most, meet the pieces of the hays of these lengths in an equal join; what meets is verified.
    """
    short = needles.select("needle").where("needle != ''").distinct().withColumn("_piece", F.left("needle", F.lit(anchor)))
    sizes = short.select(F.length("_piece").alias("_n")).distinct()  # ``anchor`` rows at most
    long = hays.select("hay").distinct().join(F.broadcast(sizes), F.length("hay") >= F.col("_n"))
    pieces = long.select("hay", F.explode(F.transform(F.sequence(F.lit(1), F.length("hay") - F.col("_n") + 1), lambda k: F.substr("hay", k, F.col("_n")))).alias("_piece")).distinct()
    return pieces.hint("merge").join(short, "_piece").where(F.col("hay").contains(F.col("needle"))).select("needle", "hay").distinct()


def module_name(paths: DataFrame, rules: DataFrame, prefix: str = "coq-", suffix: str = ".v") -> DataFrame:
    """P25: path, module, problem. The path's last segment that begins with ``prefix`` names its package: the first one that holds it.

    ``rules``: package, ordinal, dir, alias, and place (the packages' order; else they go by name). Of the package's rules the first (by
    ordinal) whose dir is in the path, with a slash after it, gives the alias; a dir of ``.`` is the path's segment itself. What follows the
    dir's first place, dotted and without ``suffix``, follows the alias. ``problem`` says why a path has no module: no package, or no rule.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s.startswith(prefix))
    keyed = paths.select("path").distinct().withColumn("segment", F.try_element_at(segments, F.lit(-1)))
    place = F.col("place") if "place" in rules.columns else F.lit(0)
    packages = rules.select("package", place.alias("place")).distinct()
    held = containing(keyed.select(F.col("segment").alias("needle")), packages.select(F.col("package").alias("hay")))
    first = held.withColumnsRenamed({"needle": "segment", "hay": "package"}).join(packages, "package").groupBy("segment").agg(F.min_by("package", F.struct("place", "package")).alias("package"))
    met = keyed.join(first, "segment", "left").join(rules.select("package", "ordinal", "dir", "alias"), "package", "left")
    mark = F.concat(F.when(F.col("dir") == ".", F.col("segment")).otherwise(F.col("dir")), F.lit("/"))
    at = F.call_function("locate", mark, F.col("path"))
    fits = met.withColumn("_at", at).withColumn("_rest", F.substr("path", F.col("_at") + F.length(mark)))
    best = fits.groupBy("path", "package").agg(F.min_by(F.struct("alias", "_rest"), F.when(F.col("_at") > 0, F.col("ordinal"))).alias("r"), F.max(F.coalesce(F.col("_at") > 0, F.lit(False))).alias("_fits"))
    dotted = F.concat_ws(".", "r.alias", F.translate("r._rest", "/", "."))
    bare = F.when(dotted.endswith(suffix), F.left(dotted, F.length(dotted) - len(suffix))).otherwise(dotted)
    problem = F.when(F.col("package").isNull(), F.lit("no package in the path")).when(~F.col("_fits"), F.lit("no rule for the path"))
    return best.select("path", F.when(F.col("_fits"), bare).alias("module"), problem.alias("problem"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _jumps(single: DataFrame, settle) -> list[DataFrame]:
    """src, dst one, two, four, ... steps on, of nodes with one way onward (``single``: src, dst)."""
    found = [single]
    for _ in range(max(1, single.count()).bit_length()):  # no path without a repeated node is longer
        a, b = found[-1].withColumnRenamed("dst", "_on"), found[-1].withColumnRenamed("src", "_on")
        then = settle(a.hint("merge").join(b, "_on").select("src", "dst"))
        if then.isEmpty():
            break
        found.append(then)
    return found


def closure(edges: DataFrame, starts: DataFrame, settle, plain_rounds: int = 8) -> DataFrame:
    """(start, node) for every node reached from each start, itself left out unless on a cycle.

    ``edges``: src, dst. ``settle`` writes a table and reads it again: each round's lineage ends there. A round joins only the pairs
    found last with the edges; it ends when there are no new ones. Where that takes more than ``plain_rounds``,
    nodes with a single way onward (other ways end at once) are jumped along, in one, two, four, ... steps, so that a chain
    takes as many rounds as its length has binary digits, and only forks take one round each. Joins are merges: a broadcast
    a round would send all of them through the driver.
    """
    def step(pairs: DataFrame, by: DataFrame) -> DataFrame:
        return pairs.hint("merge").join(by.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node"))

    frontier = settle(step(starts.select("start", F.col("start").alias("node")), edges).distinct())
    found, jumps, forks, rounds = [frontier], [], edges, 0  # tables of fewer and fewer rounds: they are merged, so there are few
    while not frontier.isEmpty():
        rounds += 1
        if rounds == plain_rounds:
            onward = settle(edges.hint("merge").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct())
            single = onward.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
            jumps = _jumps(settle(single), settle)
            # ways that end at once are gone before forks are, so a fork's own ends are still found with it
            forks = settle(edges.hint("merge").join(jumps[0].withColumn("_single", F.lit(True)), ["src", "dst"], "left_anti"))
        reached = _union(found)
        new = settle(step(frontier, forks).distinct().hint("merge").join(reached, ["start", "node"], "left_anti"))
        if jumps:
            along = frontier.unionByName(new)
            for jump in jumps:
                along = settle(along.unionByName(step(along, jump)).distinct())
            new = settle(along.hint("merge").join(reached, ["start", "node"], "left_anti"))
        frontier = new
        found.append(frontier)
        if len(found) > 8:
            found = [found[0], settle(_union(found[1:]))]
    return _union(found)


def dependencies(deps: DataFrame, starts: DataFrame, settle) -> DataFrame:
    """(path, package) of all packages that each path needs, through the dependencies of its dependencies.

    ``deps``: file, place (its order among files), ordinal (from 1), dep. ``starts``: path. A path is the first file that holds it or that it holds;
    one that is no file needs nothing. Each listed dependency's first part is a package; all but a file's first one are followed.
    """
    files = deps.groupBy("file").agg(F.min("place").alias("place"))
    wide = containing(starts.select(F.col("path").alias("needle")), files.select(F.col("file").alias("hay"))).select(F.col("needle").alias("path"), F.col("hay").alias("file"))
    narrow = containing(files.select(F.col("file").alias("needle")), starts.select(F.col("path").alias("hay"))).select(F.col("hay").alias("path"), F.col("needle").alias("file"))
    met = settle(wide.unionByName(narrow).hint("merge").join(files, "file").groupBy("path").agg(F.min_by("file", F.struct("place", "file")).alias("file")))
    followed = deps.where("ordinal > 1").select(F.col("file").alias("src"), F.col("dep").alias("dst")).distinct()
    first = met.select(F.col("file").alias("start")).distinct()
    reached = closure(followed, first, settle).unionByName(first.select("start", F.col("start").alias("node")))
    needed = reached.hint("merge").join(deps.select(F.col("file").alias("node"), F.substring_index("dep", "/", 1).alias("package")), "node").select("start", "package").distinct()
    return met.hint("merge").join(needed.withColumnRenamed("start", "file"), "file").select("path", "package").distinct()


def compile_flags(needs: DataFrame, flags: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Distinct package, flag, dir, alias of needed packages; a dir of ``.`` is the package's root."""
    return (
        needs.where(~F.col("package").isin(*skipped)).join(flags, "package")
        .withColumn("dir", F.when(F.col("dir") == ".", F.col("package")).otherwise(F.concat_ws("/", "package", "dir")))
        .select("package", "flag", "dir", "alias").distinct()
    )


def missing_packages(messages: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """(id, head, package) for every package with a rule that holds the head of the message's last line, up to its first dot.

    ``messages``: id, text. ``rules``: package, rule (its whole text). Only messages of the missing-path kind count. One that no rule answers has a
    null package; with ``strict``, it is an error. Heads meet rules by ``containing``.
    """
    last = F.element_at(F.split(F.regexp_replace("text", r"\s+$", ""), "\n"), -1)
    head = F.trim(F.substring_index(last, ".", 1))
    wanted = messages.where(F.col("text").contains(NO_PATH)).select("id", head.alias("head")).where("head != ''")
    held = containing(wanted.select(F.col("head").alias("needle")), rules.select(F.col("rule").alias("hay"))).select(F.col("needle").alias("head"), F.col("hay").alias("rule"))
    known = held.join(rules.select("rule", "package"), "rule").select("head", "package").distinct()
    out = wanted.join(known, "head", "left").select("id", "head", "package").distinct()
    error = F.raise_error(F.concat(F.lit("no package for "), F.col("head"))).cast(dict(rules.dtypes)["package"])
    return out.withColumn("package", F.coalesce("package", error)) if strict else out


def declaration_end(rows: DataFrame, by: str, order: str, is_start: Column, is_end: Column | None = None) -> DataFrame:
    """Adds ``until``: where the next row of the group that ends a declaration starts, null when the last is open."""
    after = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    ends = is_start if is_end is None else is_end
    return rows.withColumn("until", F.last(F.when(ends, F.col(order)), ignorenulls=True).over(after)).where(is_start)


def declares(line: Column) -> Column:
    """A row of an offset index that starts a declaration."""
    return F.trim(line).rlike(f"^({'|'.join(DECLARATIONS)})")


def ends_declaration(line: Column) -> Column:
    """The next declaration ends one, and so does any row that begins with a small letter and is no binder."""
    return F.trim(line).rlike(r"^\p{Ll}") & ~F.trim(line).startswith(BINDER)


def line_offsets(lines: DataFrame) -> DataFrame:
    """Adds ``from_byte`` and ``to_byte`` of each line, its line break included."""
    over = Window.partitionBy("file").orderBy("line_no")
    size = F.octet_length("line") + 1
    return lines.withColumn("to_byte", F.sum(size).over(over)).withColumn("from_byte", F.col("to_byte") - size)


def byte_to_line_range(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """File, first_line, last_line of (file, a, b); an open end (null b) is the end of the file."""
    at = line_offsets(lines)
    met = ranges.join(at, "file").where("to_byte > a and (b is null or from_byte < b)")
    return met.groupBy("file", "a", "b").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def text_before(text: Column, mark: str, suffix: str) -> Column:
    """The text before ``mark``, the statement from it to the first ``". "``, and a fixed last line; null where there is no mark."""
    at = F.locate(mark, text)
    rest = F.substr(text, at)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substring_index(rest, ". ", 1), F.lit(".\n" + suffix)))


def short_names(text: Column, keep: int = 1) -> Column:
    """Each dotted word keeps its last ``keep`` parts; a final dot and leading brackets stay."""

    def word(w: Column) -> Column:
        opened = F.regexp_extract(w, r"^[(\[]*", 0)
        closed = F.regexp_extract(w, r"\.*$", 0)
        core = F.regexp_replace(F.regexp_replace(w, r"^[(\[]*", ""), r"\.*$", "")
        return F.concat(opened, F.substring_index(core, ".", -keep), closed)

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def clean_candidates(candidates: DataFrame, most: int = 10) -> DataFrame:
    """Episode, tactic, reason: closing ``;`` becomes a dot; those citing the episode or repeating go; the first ``most`` stay.

    Pairs of tactic and reason stay together.
    """
    tidy = candidates.withColumn("tactic", F.regexp_replace(F.rtrim("tactic"), ";$", "."))
    kept = tidy.where(~F.col("tactic").contains(F.col("episode")) & ~F.col("tactic").contains("repeat"))
    once = kept.groupBy("episode", "tactic").agg(F.min_by("reason", "ord").alias("reason"), F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("episode").orderBy("ord", "tactic"))
    return once.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")

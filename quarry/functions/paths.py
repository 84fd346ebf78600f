"""Workspace paths: prefix scopes, canonical forms, projects, link targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME = "[HOME]"


def in_scope(path: Column, root: Column | str) -> Column:
    """Equal to the root or below it, literally; a null path is in no scope."""
    root = F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    return F.coalesce((path == root) | F.startswith(path, F.concat(root, F.lit("/"))), F.lit(False))


def scope_range(path: Column, root: str) -> Column:
    """The same scope as a range over sorted paths, which prunes files by their statistics."""
    root = root.rstrip("/")
    return (path == root) | ((path >= f"{root}/") & (path < f"{root}0"))


def canonical(path: Column, home: str) -> Column:
    """Paths below the home folder start with ``[HOME]``."""
    home = home.rstrip("/")
    inside = F.concat(F.lit(HOME), F.substr(path, F.lit(len(home) + 1)))
    return F.when(path == home, HOME).when(F.startswith(path, F.lit(home + "/")), inside).otherwise(path)


#: Roots of temporary workspaces and the folder of worktrees.
TEMPORARY_ROOTS = ("/tmp", "/private/tmp", "/var/folders", "/private/var/folders")
WORKTREES = ".worktrees"


def project(path: Column) -> Column:
    """The project of a workspace: its last folder, or the one above its worktrees; null for temporary,
    hidden and top-level folders."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    tree = F.array_position(parts, F.lit(WORKTREES))
    last = F.try_element_at(parts, F.lit(-1))
    hidden = F.startswith(last, F.lit("_")) | F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    temporary = F.lit(False)
    for root in TEMPORARY_ROOTS:
        temporary = temporary | F.startswith(path, F.lit(root))
    return F.when((path == "") | temporary, None).when(tree > 1, F.get(parts, (tree - 2).cast("int"))).when((tree > 0) | (F.size(parts) < 1) | hidden, None).otherwise(last)


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it leaves the tree."""
    def step(stack: Column, part: Column) -> Column:
        up = F.when((F.size(stack) == 0) | (F.try_element_at(stack, F.lit(-1)) == "!"), F.array(F.lit("!"))).otherwise(F.slice(stack, 1, F.size(stack) - 1))
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(F.contains(joined, F.lit("!")) | (joined == ""), None).otherwise(joined)


LINK = r"\[\[([^\]\n]+)\]\](?!\()|(?<!!)\[[^\]\n]*\]\(<?([^\s)>]+)>?(?:\s+[^)]*)?\)"


def link_targets(text: Column, most: int = 50) -> Column:
    """Targets of a note's wiki and markdown links in order, decoded, without alias and anchor; images
    are no links, and targets that are not plain relative paths are left out."""
    raw = F.zip_with(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)), lambda w, m: F.when(F.length(w) > 0, w).otherwise(m))
    bare = F.transform(F.slice(raw, 1, most), lambda t: F.try_url_decode(F.regexp_replace(F.regexp_replace(t, r"[|#][\s\S]*$", ""), r"\+", "%2B")))
    plain = F.filter(bare, lambda t: t.isNotNull() & (t != "") & ~t.rlike(r"[:\\]|^/"))
    return F.transform(plain, lambda t: F.when(t.rlike(r"[^/.][^/]*\.[^/.]+$"), t).otherwise(F.concat(t, F.lit(".md"))))


#: A session's scratch folder and the encoded path of the folder it ran in.
SCRATCHPAD = r"^.*/claude-[0-9]+/(-[^/]*)/[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}/scratchpad(?:/.*)?$"


def scratchpad_segment(workspace: Column) -> Column:
    """The encoded folder that a scratch folder belongs to; null for any other path."""
    return F.nullif(F.regexp_extract(workspace, SCRATCHPAD, 1), F.lit(""))


def encoded(path: Column) -> Column:
    """A path with a hyphen for every character that is no letter or digit."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


#: Roles of the two populations that an answer draws on.
HISTORY_ROLES, CURATED_ROLES = ("user", "assistant", "synthesis"), ("note",)


def population_scope(role: Column, workspace: Column, population: str, root: str | None = None) -> Column:
    """Rows of a population: notes of any workspace, or history of one (of all without a root)."""
    if population == "curated":
        return F.coalesce(role.isin(*CURATED_ROLES), F.lit(False))
    scope = in_scope(workspace, root) if root is not None else F.lit(True)
    return F.coalesce(role.isin(*HISTORY_ROLES), F.lit(False)) & scope


def renamed_home(path: Column, home: str) -> Column:
    """The canonical form of a path; a scratch folder keeps its own, as its project is decoded elsewhere."""
    return F.when(scratchpad_segment(path).isNotNull(), path).otherwise(canonical(path, home))


def link_candidates(note: Column, relative: Column, from_root: Column, tree: str) -> Column:
    """Paths that a link may mean, in order: beside its note, from the root, and in a tree; null where a
    path would leave the root."""
    folder = F.regexp_replace(note, r"[^/]*$", "")
    return F.array(normal_path(F.concat(folder, relative)), normal_path(from_root), normal_path(F.concat(F.lit(f"{tree}/"), from_root)))

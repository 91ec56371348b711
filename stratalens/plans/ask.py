"""Free-text questions to graph operators: five templates, tried in order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import graph as G

TEMPLATES = (
    ("path", re.compile(r"\b(?:path|route|chain)\b.*?\bfrom\s+(\S+)\s+to\s+(\S+)", re.I)),
    ("impact", re.compile(r"\b(?:impact|break|affected|depends? on|dependents? of)\b.*?([\w./-]+)\s*\??$", re.I)),
    ("callers", re.compile(r"\bwho\s+(?:calls|uses|imports)\s+(\S+?)\??$", re.I)),
    ("imports", re.compile(r"\bwhat\s+does\s+(\S+)\s+(?:import|use|depend on)", re.I)),
    ("find", re.compile(r"\b(?:where is|find|show)\s+(\S+?)\??$", re.I)),
)


#: words of a question that never name a node; fixed values
STOP = frozenset(
    ("who what whats which where how why when call calls called calling caller callers use uses used using user reference references referenced referencing import imports imported importing importer importers "
     "depend depends depended depending dependency dependencies the a an of to on in into by for from and or is are be does do did that this these those between path paths connection connected reach reaches reachable "
     "unused orphan orphans orphaned unreferenced dead code cycle cycles circular cyclic loop loops find show list me get all any some file files symbol symbols function functions class classes module modules thing things it its").split()
)


def words(text: str) -> list[str]:
    """Runs of identifier and path characters that may name a node."""
    return [w for w in re.split(r"[^A-Za-z0-9_/.#@-]+", text) if len(w) >= 2 and w.lower() not in STOP]


def pick(nodes: DataFrame, text: str, most: int = 10) -> tuple[str | None, list[str]]:
    """(id, []) of the first word that names exactly one node; (None, candidates) if a word names several, or none does: then suggestions for all words, at most `most`."""
    tried = words(text)
    for w in tried:
        found = [r["id"] for r in nodes.where((F.col("id") == w) | (F.lower("name") == w.lower())).select("id").orderBy("id").limit(most).collect()]
        if len(found) == 1:
            return found[0], []
        if found:
            return None, found
    out: list[str] = []
    for w in tried:
        out += [r["id"] for r in G.did_you_mean(nodes, w, most).select("id").collect() if r["id"] not in out]
    return None, out[:most]


@dataclass(frozen=True)
class Plan:
    verb: str
    args: tuple[str, ...]


def plan(question: str) -> Plan | None:
    """The first template that fits, or None."""
    for verb, pattern in TEMPLATES:
        m = pattern.search(question.strip())
        if m:
            return Plan(verb, tuple(x.strip("'\"`?.,") for x in m.groups()))
    return None


def run(p: Plan, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id (and place or hops) of the answer."""
    seeds = [G.resolve_target(nodes, a).select("id") for a in p.args]
    if p.verb == "path":
        return G.path_between(edges, seeds[0], seeds[1])
    if p.verb == "impact":
        return G.impact(edges, seeds[0])
    if p.verb == "callers":
        return G.neighbors(edges, seeds[0], "in", 1)
    if p.verb == "imports":
        return G.imports(edges, seeds[0])
    return seeds[0].select("id", F.lit(0).alias("hops"))

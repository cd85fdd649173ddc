"""Freely typed values mapped to the entries of a reference list with a BK-tree.

The tree is built over the folded names of the reference list under the Levenshtein distance (a true metric, so the
triangle inequality prunes exactly). Up to `SHARD` entries make one tree, which is broadcast; values are then searched on
the rows where they stand: one Arrow pass over two columns, each distinct value of a batch once, no shuffle that a frequent
value could skew.

A longer list is split by hash into shards of at most that size. Each distinct value is read into its probes (every string
that the decision could look up, with the distance it is looked up at), every shard returns all its entries within those
distances, and the decision is taken on the merged entries of all shards: by construction the same that one tree over the
whole list gives, since every lookup meets the same entries. A task holds one shard's tree at a time.

Reading a value: list brackets, labels, postal codes, states, country, street addresses, districts and working modes are
taken off; the first named town counts. A postal code alone names the town that owns its prefix. A word may be off by one
edit from three letters on, by two from seven.

Defined cases: null and blank values give no row in the results on typed values; every other value gives a row, with id 0
where no entry is meant; ties between entries at equal distance are broken by the postal code, then state, then count as
unmatched; repeated rows give equal rows; an empty reference list leaves all values unmatched; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.session import collect_bounded, written_table

#: Entries of one tree, and all that are ever sent to an executor at once.
SHARD = 50_000
#: Distinct federal states that a reference list may name.
MOST_STATES = 10_000


def fold(text: str) -> str:
    """Lower case, no accents, umlauts and their two-letter spellings alike, single blanks."""
    s = unicodedata.normalize("NFKC", text).casefold().replace("ß", "ss").replace("ø", "o")
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    s = s.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return " ".join(_NOISE.sub(" ", s).split())


def distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the longer string's columns."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score, mask, last = (1 << len(a)) - 1, 0, len(a), (1 << len(a)) - 1, 1 << len(a) - 1
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += (ph & last != 0) - (mh & last != 0)
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return score


def swapped(a: str, b: str) -> bool:
    """Whether one swap of neighbouring letters makes a into b."""
    if len(a) != len(b):
        return False
    off = [i for i in range(len(a)) if a[i] != b[i]]
    return len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]


def edits(a: str, b: str) -> int:
    """Edit distance that counts a swap of neighbours once; judges what the tree has found."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


@dataclass
class BKTree:
    """Nodes: [word, {distance: node}]."""

    root: list | None = None

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = [word, {}]
            return
        node = self.root
        while d := distance(word, node[0]):
            if d not in node[1]:
                node[1][d] = [word, {}]
                return
            node = node[1][d]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every word at a distance of at most `most`, nearest first."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = distance(word, node[0])
            if d <= most:
                found.append((d, node[0]))
            todo += [child for step, child in node[1].items() if d - most <= step <= d + most]
        return sorted(found)


_NOISE = re.compile(r"[^\w()|/,;+&-]+")
#: Words that may stand beside a town and say nothing about which one it is (folded).
ASIDE = {"deutschland", "germany", "bundesweit", "standort", "ort", "plz", "raum", "region", "grossraum", "nahe", "bei", "umgebung", "und", "oder", "mitte", "nord", "sud", "ost", "west", "bahnhof", "hafen", "altstadt", "neustadt", "zentrum", "innenstadt", "hybrid", "remote", "homeoffice", "home", "office", "mobil", "vor", "teilweise", "de", "d", "location", "city", "stadt", "in", "or", "arbeitsort", "einsatzort", "dienstort", "stadtteil", "metropolregion", "area", "greater"}
_STREET = re.compile(r"\b\w*(?:strasse|str|weg|platz|gasse|allee|ufer|markt|ring|damm|street|road|lane)\b\.?\s*\d*\s*\w?$")
_POSTAL = re.compile(r"(?<!\d)(?:(?:d|de)\s*-?\s*)?(\d{5})(?!\d)")
_RIVER = re.compile(r"\s*(?:-\s+(?P<h>\w+)|\(\s*(?P<p>[^()]+?)\s*\)|/\s*(?P<s>\w+)|\ba\s*d\s+(?P<a>\w+)|\ban\s+der\s+(?P<d>\w+)|\bam\s+(?P<m>\w+))\s*$")
_PARTS = re.compile(r"\s*(?:\||,|;|\+|&|\s/\s|/|\bund\b|\boder\b|\bor\b|\band\b)\s*")
_WORDS = re.compile(r"[ -]+")
_MARKUP = re.compile(r"\{\{|\}\}|\$\{|<[^>]*>|<%|%\w+%|__\w+__|#\w+|\[object")


def states_pattern(states: set[str]) -> re.Pattern | None:
    """Any of the folded state names, with the signs around it."""
    names = sorted(map(re.escape, filter(None, states)), key=lambda x: (-len(x), x))
    return re.compile(r"\s*[(,/-]*\s*\b(" + "|".join(names) + r")\b\s*\)?") if names else None


def reach(name: str, postal: int) -> int:
    """Edits that a name may be off by: none below three letters, one below seven, two from there or beside a known postal code."""
    return 0 if len(name) < 3 else 2 if len(name) >= 7 or postal > 0 else 1


Entry = tuple[int, str, str | None, str | None, str | None]


@dataclass
class Gazetteer:
    """Entries of the reference list (id, name, second name, state, postal prefix), folded and indexed."""

    names: dict[str, list[int]] = field(default_factory=dict)
    rivers: dict[tuple[str, str], int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    states: dict[int, str] = field(default_factory=dict)
    rows: dict[int, Entry] = field(default_factory=dict)
    tree: BKTree = field(default_factory=BKTree)
    river_names: set[str] = field(default_factory=set)
    river_tree: BKTree = field(default_factory=BKTree)
    any_state: re.Pattern | None = None

    @classmethod
    def build(cls, rows: Iterable[Entry], any_state: re.Pattern | None = None, rivers: Iterable[str] = ()) -> Gazetteer:
        """The index of these entries; the states of the whole list and further rivers where the entries are a part of it."""
        g = cls(any_state=any_state, river_names=set(rivers))
        for row in sorted(rows):
            cid, name, alt, state, prefix = row
            g.rows[cid] = row
            g.states[cid] = fold(state or "")
            if prefix:
                g.prefixes[prefix] = cid
            for n in (name, alt):
                if not n:
                    continue
                base, river = cls.split_river(fold(n))
                if river:
                    g.rivers[base, river] = cid
                    g.river_names.add(river)
                for spelled in {base} | ({f"{base} {river}"} if river else set()) | ({base.removeprefix("bad ").removeprefix("sankt ")} if base.startswith(("bad ", "sankt ")) else set()):
                    g.names.setdefault(spelled, []).append(cid)
        for n in sorted(g.names):
            g.tree.add(n)
        for r in sorted(g.river_names):
            g.river_tree.add(r)
        if any_state is None:
            g.any_state = states_pattern(set(g.states.values()))
        return g

    # the lookups; `Probes` records them instead

    def ids_of(self, name: str) -> list[int]:
        return self.names.get(name, [])

    def within(self, name: str, most: int) -> list[tuple[int, str]]:
        return self.tree.within(name, most)

    def of_river(self, base: str, river: str) -> int:
        return self.rivers.get((base, river), 0)

    def owner(self, prefix: str) -> int:
        """The entry that owns a postal prefix, -1 if none does."""
        return self.prefixes.get(prefix, -1)

    def is_river(self, word: str) -> bool:
        return word in self.river_names

    def river_like(self, word: str) -> str:
        """The word itself if it is a river, else the first river at distance one, else the word."""
        return word if word in self.river_names else min((r for _, r in self.river_tree.within(word, 1)), default=word)

    @staticmethod
    def split_river(s: str) -> tuple[str, str]:
        m = _RIVER.search(s)
        if not m:
            return s.strip(), ""
        return s[: m.start()].strip(), next(x for x in m.groups() if x)

    def lookup(self, s: str, postal: int, state: str, typos: bool = True) -> int:
        """The entry of one folded candidate, 0 if there is none."""
        s = re.sub(r"^(?:b|bad)[ -]+", "bad ", s)
        s = re.sub(r"^(?:st|skt|sankt|saint)[ -]+", "sankt ", s)
        base, river = self.split_river(s)
        if river and (cid := self.of_river(base, river)):
            return cid
        for name in dict.fromkeys((s, base)):
            if ids := self.ids_of(name):
                return self.pick(ids, postal, state, river)
        if not typos:
            return 0
        words = s.split(" ")
        if len(words) >= 3 and (ids := self.ids_of(words[0])):
            return self.pick(ids, postal, state, words[-1])
        tries = dict.fromkeys((s, base, words[0] if len(words) >= 3 and not s.startswith(("bad ", "sankt ")) else base))
        if not river and len(words) >= 3:
            river = words[-1].strip("()")
        if river:
            river = self.river_like(river)
        for name in tries:
            most = reach(name, postal)
            if not most:
                continue
            found = [(0.5 if swapped(name, w) else d, w) for d, w in self.within(name, 2) if d <= most or swapped(name, w)]
            if postal > 0 and (near := [(d, w) for d, w in self.within(name, 4) if postal in self.ids_of(w)]):
                return postal if near else 0
            if not found and len(name) >= 10:  # two swaps of neighbours are up to four single edits
                found = [(2, w) for _, w in self.within(name, 4) if edits(name, w) <= 2]
            if not found or postal < 0:
                continue
            best = min(found)[0]
            ids = sorted({i for d, w in found if d == best for i in self.ids_of(w)})
            if river:
                ids = [c for c in ids if self.has_river(c, river)] or ids
            if cid := self.pick(ids, postal, state, river):
                return cid
        return 0

    def has_river(self, cid: int, river: str) -> bool:
        return any(n and self.split_river(fold(n))[1] == river for n in self.rows[cid][1:3])

    def pick(self, ids: list[int], postal: int, state: str, river: str) -> int:
        ids = sorted(set(ids))
        if len(ids) == 1:
            return ids[0]
        if postal in ids:
            return postal
        here = [i for i in ids if state and self.states[i] == state]
        if len(here) == 1:
            return here[0]
        with_river = [i for i in ids if river and self.has_river(i, river)]
        return with_river[0] if len(with_river) == 1 else 0

    def meant(self, value: str) -> int:
        """The id of the first town that a value means, 0 if none."""
        if _MARKUP.search(value):
            return 0
        s = value.strip()
        s = re.sub(r"^[\[\s\"']+|[\]\s\"']+$", "", s) if s[:1] == "[" and '"' in s else s
        s = fold(s.replace("|", " | ").replace("•", " | "))
        s = re.sub(r"\(\s*(?:hybrid|remote|homeoffice|home office|teilweise remote|m w d)\s*\)", " ", s)
        s = re.sub(r"(\w)/\s*(\w+)", lambda m: f"{m[1]} ({m[2]})" if self.is_river(m[2]) else m[0], s)
        postal = 0
        if m := _POSTAL.search(s):
            postal = self.owner(m[1][:3])
            s = _POSTAL.sub(" ", s)
        s = re.sub(r"^(?:[\w ]*?(?:standort|einsatzort|arbeitsort|dienstort|location|plz|ort|raum|grossraum|region))\b\s*", " ", s)
        s = " ".join(s.split()).strip(" ,;/|-&+")
        if not s:
            return max(0, postal)
        state = ""
        if self.any_state and (m := self.any_state.search(s)):
            state = m[1]
            s = " ".join(self.any_state.sub(" ", s).split()).strip(" ,;/|-&+")
        if not s:
            return max(0, postal)
        if whole := self.lookup(s, postal, state, typos=False):
            return whole
        for part in _PARTS.split(s):
            part = part.strip(" -()/")
            words = _WORDS.split(part)
            if not part or all(w in ASIDE for w in words):
                continue
            if _STREET.search(part) and not self.ids_of(part):
                continue
            first = len(words) - len(words[next((i for i, w in enumerate(words) if w not in ASIDE), 0) :])
            last = len(words)
            while last > first + 1 and words[last - 1] in ASIDE | {"km"} or last > first + 1 and words[last - 1].isdigit():
                last -= 1
            cores = dict.fromkeys((part, " ".join(words[first:last]), re.sub(r"\s*\([^)]*\)?\s*$", "", part)))
            for typos in (False, True):
                for core in cores:
                    if core and (cid := self.lookup(core, postal, state, typos)):
                        return cid
            if postal > 0 and (near := self.lookup(" ".join(words[first:last]), postal, state)):
                return near
        return 0


class Probes(Gazetteer):
    """A gazetteer that knows nothing and records what it is asked: a superset of the lookups that any list could lead to."""

    def __init__(self, any_state: re.Pattern | None, rivers: bool, postal: int):
        super().__init__(any_state=any_state)
        self.near: dict[str, int] = {}
        self.codes: set[str] = set()
        self.waters: set[str] = set()
        self._rivers, self._postal = rivers, postal

    def ids_of(self, name: str) -> list[int]:
        self.near.setdefault(name, 0)
        return []

    def within(self, name: str, most: int) -> list[tuple[int, str]]:
        # the widest distance that any branch asks for
        self.near[name] = 4 if len(name) >= 10 or self.codes else max(most, self.near.get(name, 0))
        return []

    def of_river(self, base: str, river: str) -> int:
        self.near.setdefault(base, 0)
        return 0

    def owner(self, prefix: str) -> int:
        self.codes.add(prefix)
        return self._postal

    def is_river(self, word: str) -> bool:
        self.waters.add(word)
        return self._rivers

    def river_like(self, word: str) -> str:
        self.waters.add(word)
        return word


def probes(value: str, any_state: re.Pattern | None) -> tuple[dict[str, int], set[str], set[str]]:
    """Names with the distance to search them at, postal prefixes, and words that may be rivers: all that `meant` could look up."""
    near: dict[str, int] = {}
    codes: set[str] = set()
    waters: set[str] = set()
    for rivers in (False, True):
        for postal in (1, -1):  # what a postal code is found to be, where the value holds one
            p = Probes(any_state, rivers, postal)
            p.meant(value)
            for n, most in p.near.items():
                near[n] = max(most, near.get(n, 0))
            codes |= p.codes
            waters |= p.waters
    return near, codes, waters


def hits(g: Gazetteer, value: str) -> tuple[list[Entry], list[str]]:
    """The entries and rivers of one shard that the decision on a value could meet."""
    near, codes, waters = probes(value, g.any_state)
    ids = {i for n, most in near.items() for _, w in (g.within(n, most) if most else [(0, n)]) for i in g.ids_of(w)}
    ids |= {i for c in codes if (i := g.owner(c)) >= 0}
    rivers = {r for w in waters for _, r in g.river_tree.within(w, 1)}
    return [g.rows[i] for i in sorted(ids)], sorted(rivers)


_COLUMNS = ("city_id", "city_name", "alt_name", "federal_state", "postal_prefix")
_ENTRY = "struct<city_id:bigint,city_name:string,alt_name:string,federal_state:string,postal_prefix:string>"


def _one_tree(typed: DataFrame, listed: DataFrame, any_state: re.Pattern | None, literal: bool) -> DataFrame:
    """One pass over the rows with the whole list in a broadcast."""
    entries = [tuple(r) for r in collect_bounded(listed, SHARD, "the reference list")]
    sent = typed.sparkSession.sparkContext.broadcast((Gazetteer.build(entries, any_state), frozenset() if literal else frozenset(e[1] for e in entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer, left_out = sent.value
        known: dict[str, int] = {}
        for batch in batches:
            values = batch.column(1).to_pylist()
            if len(known) > 500_000:
                known.clear()
            for v in set(values) - known.keys():
                known[v] = gazetteer.meant(v) if v.strip() and v not in left_out else -1
            out = pa.array([known[v] for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["k", "v", "city_id"]).filter(pa.compute.greater_equal(out, 0))

    return typed.mapInArrow(run, "k string, v string, city_id bigint")


def _sharded(typed: DataFrame, listed: DataFrame, any_state: re.Pattern | None, literal: bool, shards: int) -> DataFrame:
    """Distinct values searched in each shard, the winners merged by value, and the decisions joined back to the rows."""
    spark = typed.sparkSession
    distinct = typed.select("v").distinct().filter(F.trim("v") != "")
    if not literal:
        distinct = distinct.join(listed.select(F.col("city_name").alias("v")).distinct(), "v", "left_anti")
    values = written_table(distinct, "typed-values")
    parts = []
    for shard in range(shards):
        part = listed.filter(F.pmod(F.xxhash64("city_id", "city_name"), F.lit(shards)) == shard)
        sent = spark.sparkContext.broadcast(Gazetteer.build([tuple(r) for r in collect_bounded(part, SHARD, "a shard of the reference list")], any_state))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("city_id", pa.int64()), *[(c, pa.string()) for c in _COLUMNS[1:]]]))
            for batch in batches:
                found = [hits(sent.value, v) for v in batch.column(0).to_pylist()]
                entries = pa.array([[dict(zip(_COLUMNS, e)) for e in es] for es, _ in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), entries, pa.array([r for _, r in found], pa.list_(pa.string()))], ["v", "entries", "rivers"])

        parts.append(values.mapInArrow(search, f"v string, entries array<{_ENTRY}>, rivers array<string>").filter("size(entries) > 0 or size(rivers) > 0"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    # of each value: the entries within its thresholds, from all shards
    merged = merged.unionByName(values.select("v", F.array().cast(f"array<{_ENTRY}>").alias("entries"), F.array().cast("array<string>").alias("rivers")))
    merged = merged.groupBy("v").agg(F.flatten(F.collect_list("entries")).alias("entries"), F.flatten(F.collect_list("rivers")).alias("rivers"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, entries, rivers = (c.to_pylist() for c in batch.columns)
            ids = [Gazetteer.build([tuple(e[c] for c in _COLUMNS) for e in es], any_state, rs).meant(v) for v, es, rs in zip(values, entries, rivers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], ["v", "city_id"])

    # a frequent value meets one row of the other side: the adaptive plan splits its partition
    return typed.join(merged.mapInArrow(decide, "v string, city_id bigint"), "v").select("k", "v", "city_id")


#: Stands for a list without states; matches nothing.
_NEVER = re.compile(r"(?!)()")


def map_values(df: DataFrame, reference: DataFrame, key: str, value: str, literal: bool = True) -> DataFrame:
    """``key, value, city_id`` for every row whose value is neither null nor blank; 0 is unmatched. Without `literal`, values that are a name of the list as it stands are left out."""
    listed = reference.select(*_COLUMNS).filter(F.col("city_name").isNotNull() & F.col("city_id").isNotNull())
    size = listed.count()
    states = {fold(r[0]) for r in collect_bounded(listed.select("federal_state").filter(F.col("federal_state").isNotNull()).distinct(), MOST_STATES, "the list of states")}
    typed = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))
    any_state = states_pattern(states) or _NEVER
    done = _one_tree(typed, listed, any_state, literal) if size <= SHARD else _sharded(typed, listed, any_state, literal, -(-size // max(1, SHARD // 2)))
    return done.withColumnsRenamed({"k": key, "v": value})


def typed_places(jobs: DataFrame, reference: DataFrame, key: str = "job_id", value: str = "location") -> DataFrame:
    """``key, city_id`` of the rows whose value is not literally a name of the list."""
    return map_values(jobs, reference, key, value, literal=False).select(key, "city_id").distinct()

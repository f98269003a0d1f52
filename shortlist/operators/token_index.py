"""Token index over search terms, for jobs whose lists are too long to try term by term.

A token is a run of ASCII letters and digits, or any other single character but the space. A term that
occurs in a sentence on token boundaries has all its tokens there as whole tokens, so each term is filed
under one of them, the one that the fewest terms of its job have, and a sentence only meets the
terms filed under its own tokens. The boundary test then decides as it does without an index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.cluster import BROADCAST_ROWS, at_most, salted_lookup
from shortlist.functions.text import boundary_match, boundary_pattern, normalize

LONG_LIST = 64  # terms of a job from which its list is looked up by token
INDEX_SHARE = 10  # an index of narrow rows is broadcast up to so many times the usual bound
GROUP_CVS = 1000  # CVs that meet their job's list at once
_TOKEN = r"[a-z0-9]+|[^a-z0-9 ]"


def tokens(norm: Column) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(_TOKEN), F.lit(0)))


def by_rarest_token(terms: DataFrame) -> DataFrame:
    """Distinct terms (job_position_id, needle) with `token`, where each is filed, and `pattern`."""
    listed = terms.select("job_position_id", "needle", F.explode(tokens(F.col("needle"))).alias("token")).distinct()
    held = listed.groupBy("job_position_id", "token").agg(F.count(F.lit(1)).alias("_terms"))
    rarity = F.struct("_terms", (-F.length("token")).alias("_short"), "token")
    rarest = listed.join(held, ["job_position_id", "token"]).groupBy("job_position_id", "needle").agg(F.min_by("token", rarity).alias("token"))
    return rarest.withColumn("pattern", boundary_pattern(F.col("needle")))


def holders(terms: DataFrame) -> DataFrame:
    """(job_position_id, needle, holders): the requirements that have a term, by the terms each lists before it.
    A sentence that holds none of `earlier` meets the requirement through this term and no other."""
    place = ["job_position_id", "req_pos", "requirement_id"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("needle_pos", "needle"))), lambda n: n["needle"])
    listed = terms.groupBy(*place).agg(F.array_distinct(ordered).alias("_list"))
    each = listed.select(*place, "_list", F.posexplode("_list").alias("_at", "needle"))
    each = each.withColumn("earlier", F.slice("_list", F.lit(1), F.col("_at")))
    alike = each.groupBy("job_position_id", "needle", "earlier").agg(F.collect_list(F.struct("req_pos", "requirement_id")).alias("reqs"))
    return alike.groupBy("job_position_id", "needle").agg(F.collect_list(F.struct("earlier", "reqs")).alias("holders"))


def is_long(terms: DataFrame) -> bool:
    """Whether any job has a long list."""
    if at_most(terms, LONG_LIST):
        return False
    most = terms.groupBy("job_position_id").count().agg(F.max("count")).first()[0]
    return (most or 0) > LONG_LIST


def match_by_token(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences (cv_id, job_position_id, pos, sentence; cv_id and pos are the key) that hold a term of a
    requirement of their job, once per requirement, by an equi-join on (job, token).

    Sentences meet distinct terms, and a term's requirements only once it was found. A requirement counts at
    the first of its terms that the sentence holds, so no hit arises twice and none moves. An index
    counted small is broadcast. Otherwise keys and tokens move, then the texts join the candidates for the
    boundary test and, once a term, meet its requirements.
    """
    index = by_rarest_token(terms)
    key = ["cv_id", "job_position_id", "pos"]
    term = ["job_position_id", "needle"]
    prepared = sentences.select(*key, "sentence", normalize(F.col("sentence")).alias("_norm"))
    spelled = prepared.select("*", F.explode(tokens(F.col("_norm"))).alias("token"))
    on = ["job_position_id", "token"]
    found = boundary_match(F.col("_norm"), F.col("needle"), F.col("pattern"))
    if at_most(terms, INDEX_SHARE * BROADCAST_ROWS):
        met = spelled.join(F.broadcast(index.join(holders(terms), term)), on).where(found)
    else:
        narrow = salted_lookup(spelled.select(*key, "token"), index, on, ["cv_id", "pos"], bounded_by=terms)
        hits = narrow.drop("token").join(prepared, key).where(found)
        met = salted_lookup(hits, holders(terms), term, ["cv_id", "pos"], bounded_by=terms)
    held = met.select(*key, "sentence", "_norm", F.inline("holders"))
    first = held.where((F.size("earlier") == 0) | ~F.exists("earlier", lambda n: boundary_match(F.col("_norm"), n)))
    return first.select(*key, "sentence", F.inline("reqs")).select("cv_id", "job_position_id", "req_pos", "requirement_id", "pos", "sentence")


def _dealt(cvs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CVs dealt to groups of about `GROUP_CVS` within their job, and each job's entries once per group of it."""
    held = cvs.groupBy("job_position_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_CVS)).cast("int").alias("_groups"))
    many = F.broadcast(held.where(F.col("_groups") > 1).withColumnRenamed("job_position_id", "_job"))
    on = F.col("job_position_id").eqNullSafe(F.col("_job"))
    groups = F.coalesce("_groups", F.lit(1))
    dealt = cvs.join(many, on, "left").withColumn("_group", F.pmod(F.xxhash64("cv_id", "_norms"), groups).cast("int")).drop("_job", "_groups")
    entries = lists.select("job_position_id", F.posexplode("requirements").alias("_at", "r")).select(
        "job_position_id", "_at", F.transform("r.needles", lambda n: n["needle"]).alias("terms"), "r.weight", "r.is_required"
    )
    copies = entries.join(many, on, "left").withColumn("_group", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_job", "_groups")
    return dealt, copies


def match_in_groups(cvs: DataFrame, lists: DataFrame, placed: bool) -> DataFrame:
    """CVs (cv_id, job_position_id, _norms: their normalised sentences, ...) matched against their job's list
    (job_position_id, requirements), short or long, one group of CVs of a job at a time.

    A CV keeps one bit per sentence for each distinct term; a requirement takes its terms' bits together, so a CV
    costs its matches and one step per requirement, however many sentences hit. With `placed`, `_placed` has
    the places of the matched sentences per requirement, in list order. Otherwise the CV gets what its verdict
    needs: `_hit` and `_all` (weights scored and listed), `_missing` and `_required`.
    """
    from shortlist.functions import fixed

    weak, strong, double = fixed.WEAK_MATCH_SCORE, fixed.STRONG_MATCH_COUNT, fixed.REQUIRED_WEIGHT_MULTIPLIER
    spelling = _TOKEN
    dealt, copies = _dealt(cvs, lists)
    kinds = {"_placed": "array<array<int>>"} if placed else {"_hit": "double", "_all": "double", "_missing": "int", "_required": "int"}
    schema = dealt.select("*", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()]).schema

    def run(left, right):
        import re

        import numpy as np
        import pyarrow as pa

        plain = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        words = re.compile(spelling, re.S)

        def holds(norm, needle):
            at = norm.find(needle)
            while at >= 0:
                end = at + len(needle)
                if (at == 0 or norm[at - 1] not in plain) and (end == len(norm) or norm[end] not in plain):
                    return True
                at = norm.find(needle, at + 1)
            return False

        right = right.sort_by("_at")
        listed = right.column("terms").to_pylist()
        number = {}
        for terms in listed:
            for t in terms:
                number.setdefault(t, len(number))
        wide = max([1, *map(len, listed)])
        ids = np.full((len(listed), wide), len(number), np.int64)  # the last number: no term
        for at, terms in enumerate(listed):
            ids[at, : len(terms)] = [number[t] for t in terms]
        spelled = {t: set(words.findall(t)) for t in number}
        common = {}
        for found in spelled.values():
            for w in found:
                common[w] = common.get(w, 0) + 1
        filed = {}
        for t, found in spelled.items():
            filed.setdefault(min(found, key=lambda w: (common[w], -len(w), w)), []).append((t, number[t]))
        required = np.array([bool(x) for x in right.column("is_required").to_pylist()], bool)
        weight = np.array([float(x or 0) for x in right.column("weight").to_pylist()]) * np.where(required, double, 1.0)
        total = float(np.add.accumulate(weight)[-1]) if len(listed) else 0.0

        def bits_of(norms):
            bits = np.zeros((max(1, -(-len(norms) // 64)), len(number) + 1), np.uint64)
            for at, norm in enumerate(norms):
                hit = [i for w in set(words.findall(norm or "")) for t, i in filed.get(w, ()) if t == w == norm or holds(norm, t)]
                if hit:
                    bits[at >> 6, hit] |= np.uint64(1 << (at & 63))
            together = bits[:, ids[:, 0]]
            for k in range(1, wide):
                together |= bits[:, ids[:, k]]
            return together

        def places(norms):
            by_entry = bits_of(norms).T.copy()  # entries x words
            flags = np.unpackbits(by_entry.view(np.uint8).reshape(len(listed), by_entry.shape[1] * 8), axis=1, bitorder="little")
            entry, place = np.nonzero(flags)
            offsets = np.searchsorted(entry, np.arange(len(listed) + 1))
            return offsets, place

        columns = {name: [] for name in kinds}
        for norms in left.column("_norms").to_pylist():
            if placed:
                offsets, place = places(norms or []) if listed else (np.zeros(1, np.int64), np.zeros(0, np.int64))
                columns["_placed"].append((offsets, place))
                continue
            if not listed:
                got = (0.0, 0.0, 0, 0)
            else:
                count = np.bitwise_count(bits_of(norms or [])).sum(axis=0, dtype=np.int64)
                score = np.where(count == 0, 0.0, np.where(count >= strong, 1.0, weak))
                got = (float(np.add.accumulate(score * weight)[-1]), total, int((required & (count == 0)).sum()), int(required.sum()))
            for name, value in zip(kinds, got):
                columns[name].append(value)
        if placed:
            pieces = []
            for offsets, place in columns["_placed"]:
                inner = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place, pa.int32()))
                pieces.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
            added = [pa.chunked_array(pieces, pa.list_(pa.list_(pa.int32())))]
        else:
            types = {"double": pa.float64(), "int": pa.int32()}
            added = [pa.array(columns[n], types[k]) for n, k in kinds.items()]
        for name, column in zip(kinds, added):
            left = left.append_column(name, column)
        return left.combine_chunks()

    on = ["job_position_id", "_group"]
    return dealt.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(run, schema).drop("_group")

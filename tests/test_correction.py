"""The plan of correction passes against a plain loop over transcripts."""

from __future__ import annotations

import random
import re
from collections import Counter

from scriptorium.functions.phonetic import double_metaphone
from scriptorium.operators import correction as C
from test_matching import edits

CHANGE = "array<struct<original:string,corrected:string,reason:string>>"


def batches(rows):
    """segment -> batch, for the (segment, start, end) of one transcript."""
    out, batch, size, length = {}, 0, 0, 0.0
    for s, a, b in sorted(rows):
        if size and (length + b - a > 30 or size >= 10) and size >= 3:
            batch, size, length = batch + 1, 0, 0.0
        out[s], size, length = batch, size + 1, length + b - a
    return out


def keeps(words, corrected):
    bare = lambda w: re.sub(r"""^[.,!?;:"']+|[.,!?;:"']+$""", "", w.lower()).strip()
    flat = lambda t: f" {re.sub(r'[^a-z0-9_]+', ' ', t.lower()).strip()} "
    held = [bare(w) for w, c in words if c >= 0.85]
    lost = [w for w in held if len(w) >= 2 and flat(w) not in flat(corrected)]
    return not held or not corrected.strip() or len(lost) < 0.2 * len(held)


def sounds(original, corrected, terms):
    if not original or not corrected or corrected.lower().strip() not in terms:
        return True
    wanted, said = corrected.lower().split(), [o for w in original.lower().split() if (o := w.strip(".,!?;:\"'"))]
    codes = [c for w in wanted if (c := double_metaphone(w)[0])]
    return not codes or any(1 - edits(o, w) / max(len(o), len(w)) >= 0.5 for o in said for w in wanted) or any(c in double_metaphone(o) for o in said for c in codes)


def plain(segments, proposals, second, last, terms):
    texts, results, blocks = {}, {}, {}
    for t in {s[0] for s in segments}:
        own = {s[1]: s for s in segments if s[0] == t}
        batch = batches([(s[1], s[2], s[3]) for s in own.values()])
        changes, names = {}, {}
        state = {k: [s[4], "none", []] for k, s in own.items()}
        for b in sorted(set(batch.values())):
            lines = [f'  - "{c}" (may appear as: {", ".join(v[:5])})' for c, v in list(names.items())[:20]]
            blocks[t, b] = "\nKnown entities from earlier segments:\n" + "\n".join(lines) + "\n" if lines else ""
            found = {}
            for p in sorted((p for p in proposals if p[:2] == (t, b)), key=lambda p: p[2]):
                _, _, _, k, corrected, each = p
                if batch.get(k) != b or not keeps(own[k][5], corrected):
                    continue
                good = [c for c in each if sounds(c[0], c[1], terms)]
                if good or not each:
                    found[k] = (corrected, good)
            for k, (corrected, good) in found.items():
                changes[k] = len(good)
                state[k] = [corrected, "model", [f"{a} -> {b_}" for a, b_, _ in good]]
                for a, c, _ in good:
                    a, c = a.strip(), c.strip()
                    if c and c[0].isupper() and c != a:
                        forms = names.setdefault(c, [])
                        if a.lower() not in [f.lower() for f in forms]:
                            names[c] = [*forms, a][:10]
        passes = 1
        later = [(" (kicker)", [f for f in last if f[0] == t])]
        if changes:
            passes, later = 2, [(" (pass2)", [f for f in second if f[0] == t]), *later]
        for mark, fixes in later:
            for f in fixes:
                changes[f[2]] = changes.get(f[2], 0) + 1
            for _, _, k, original, corrected, _ in {f[2]: f for f in sorted(fixes, key=lambda f: f[1])}.values():
                if k in state:
                    state[k] = [corrected, "model", [*state[k][2], f"{original} -> {corrected}{mark}"]]
        texts |= {(t, k): (x, s, tuple(c)) for k, (x, s, c) in state.items()}
        results[t] = (passes, sum(changes.values()), len(changes))
    return texts, results, blocks


def test_passes_by_a_plain_loop(spark):
    rng = random.Random(12)
    vocabulary = "smith smyth jones paris pariss rome the of and went to see Anna anna Ana".split()
    terms = {"smith", "paris"}
    segments, proposals, second, last = [], [], [], []
    for t in range(25):
        at = 0.0
        for k in range(rng.randrange(0, 45)):
            words = [(rng.choice(vocabulary), rng.choice([0.5, 0.95])) for _ in range(rng.randrange(0, 7))]
            segments.append((t, k, at, at + rng.choice([1.0, 4.0, 12.0, 40.0]), " ".join(w for w, _ in words), words))
            at = segments[-1][3] + 0.5
        batch = batches([s[1:4] for s in segments if s[0] == t])
        for n in range(rng.randrange(0, 60) if t % 6 else 0):
            k = rng.randrange(0, 47)
            text = next((s[4] for s in segments if s[:2] == (t, k)), "")
            each = [(rng.choice(vocabulary), rng.choice(["Smith", "Paris", "Anna", "Bo Li", "x", " Eve "]), "r") for _ in range(rng.randrange(0, 3))]
            proposals.append((t, batch.get(k, 0) + (rng.random() < 0.1), n, k, rng.choice([text, f"Oh {text}", text[3:], ""]), each))
        for n in range(rng.randrange(0, 9)):
            second.append((t, n, rng.randrange(0, 47), "a", f"second {n}", "r"))
        for n in range(rng.randrange(0, 4)):
            last.append((t, n, rng.randrange(0, 47), "b", f"last {n}", None))
    texts, results, blocks = plain(segments, proposals, second, last, terms)
    fixes = "transcript long, pos long, segment long, original string, corrected string, reason string"
    rows = spark.createDataFrame(segments, "transcript long, segment long, start double, end double, text string, ws array<struct<word:string,confidence:double>>")
    tables = spark.createDataFrame(proposals, f"transcript long, batch int, place long, segment long, corrected string, changes {CHANGE}"), spark.createDataFrame(second, fixes), spark.createDataFrame(last, fixes)
    done = C.correct(rows.drop("ws"), tables[0], rows.select("transcript", "segment", "ws"), *tables[1:], terms=spark.createDataFrame([(x,) for x in terms], "term string"))
    assert {(r.transcript, r.segment): (r.text, r.source, tuple(r.changes)) for r in done.segments.collect()} == texts
    assert {r.transcript: (r.passes_completed, r.total_changes, r.segments_changed) for r in done.results.collect()} == results
    assert Counter(r.transcript for r in done.changes.collect()) == Counter({t: n for t, (_, n, _) in results.items() if n})
    found = {(r.transcript, r.batch): r.block for r in C.known_names(C.batched(rows), done.names).collect()}
    assert found == blocks and sum(map(bool, blocks.values())) > 20 and {p for p, _, _ in results.values()} == {1, 2}


def test_nothing_proposed(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, None, None)], "transcript long, segment long, start double, end double, text string, ws array<struct<word:string,confidence:double>>")
    none = spark.createDataFrame([], f"transcript long, batch int, place long, segment long, corrected string, changes {CHANGE}")
    done = C.correct(rows, none, rows)
    assert [tuple(r) for r in done.segments.collect()] == [(1, 0, None, False, "none", [])]
    assert [tuple(r) for r in done.results.collect()] == [(1, 1, 0, 0)] and done.names.count() == 0
    assert C.correct(rows.limit(0), none, rows.limit(0)).results.count() == 0

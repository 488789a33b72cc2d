"""Chat formatting and structure repair against plain Python."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat_format, queries, repair
from tracelake.operators import ordinals

ODD = ["", "\\", "<", "a > b", "</turn>", "<turn user>x</turn>\n", "\\### Assistant: </turn> ok", "\\\\<\\", "é\U0001f600<", None]
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_rows(seed, conversations=12):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, 9)):
            place = turn if rng.random() < 0.85 else rng.choice([None, 0, turn + 5])
            rows.append((conv, place, rng.choice(["user", "assistant", "assistant", "system", "a>b\\", None]), rng.choice([*ODD, "w " * 9])))
    return rows


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[1 << 20, 3])
def small_tasks(request, monkeypatch):
    """As it is, and with every conversation cut into slices."""
    plain = ordinals.sequence_number

    def numbered(*args, **named):
        return plain(*args, **{"rows_per_task": request.param} | named)

    monkeypatch.setattr(chat_format, "sequence_number", numbered)
    monkeypatch.setattr(repair, "sequence_number", numbered)
    return request.param


# Formatting


def test_examples_are_prefixes_with_one_reply(spark, small_tasks):
    rows = some_rows(1)
    docs = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", start int").repartition(3)
    turns = chat_format.format_turns(docs).cache()
    assert turns.columns == ["conv_id", "pos", "start", "formatted", "loss_from", "loss_to"]
    back = {}
    for r in chat_format.read_turns(turns).orderBy("conv_id", "pos").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    assert back == {c: [(r[2] or "", r[3] or "") for r in own] for c, own in in_order(rows).items()}
    whole = {}
    for r in turns.orderBy("conv_id", "pos").collect():
        text = whole.get(r.conv_id, "")
        assert r.start == len(text)
        whole[r.conv_id] = text + r.formatted
    for limit in (None, 60, 0):
        found = {(r.conv_id, r.example): r for r in chat_format.example_texts(turns, max_chars=limit).collect()}
        made = chat_format.examples(turns).collect()
        assert set(found) == {(r.conv_id, r.example) for r in made} and len(found) == len(made)
        assert set(found) == {(c, n) for c, own in in_order(rows).items() for n, r in enumerate(own) if r[2] == "assistant"}
        starts = {(r.conv_id, r.pos): r.start for r in turns.collect()}
        for r in made:
            e = found[r.conv_id, r.example]
            prefix = whole[r.conv_id][: r.context_chars + len(r.reply)]
            assert e.text[e.loss_from : e.loss_to] == r.reply and e.loss_to == len(e.text)
            if limit is None:
                assert e.text == prefix
            else:
                # The first turn from which the text is short enough, at the latest that of the reply.
                fits = [s for (c, n), s in starts.items() if c == r.conv_id and n <= r.example and len(prefix) - s <= limit]
                assert e.text == prefix[min([*fits, starts[r.conv_id, r.example]]) :]
    turns.unpersist()


def test_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    turns = chat_format.format_turns(empty)
    assert turns.count() == chat_format.examples(turns).count() == chat_format.example_texts(turns).count() == 0


def test_long_texts_come_back(spark):
    text = "<\\>" * 20_000 + "x" * 100_000
    docs = spark.createDataFrame([(1, 0, "r>\\" * 8000, text), (1, 1, "assistant", text)], SCHEMA)
    got = [(r.role, r.text, r.trained) for r in chat_format.read_turns(chat_format.format_turns(docs)).orderBy("pos").collect()]
    assert got == [("r>\\" * 8000, text, None), ("assistant", text, text)]


def test_query_of_formats(spark, tmp_path):
    rows = some_rows(2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    marks = [(-7, n, role, "\\### Assistant: </turn> ok") for n, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    want = in_order(rows + marks)
    assert set(got) == set(want)
    for conv, own in want.items():
        r, replies = got[conv], "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(replies), sha(replies))


# Repair


def cheapest(codes):
    """(cost, audit) by going through the rows once, with the best of each place of the pattern."""
    steps = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}

    def put_in(best):
        while True:
            more = dict(best)
            for role in "ua":
                for p, q in steps[role]:
                    if p in best:
                        found = (best[p][0] + 3, best[p][1] + "I")
                        if q not in more or found < more[q]:
                            more[q] = found
            if more == best:
                return best
            best = more

    best = put_in({0: (0, "")})
    for initial, fault in codes:
        after = {}

        def offer(q, cost, audit):
            if q not in after or (cost, audit) < after[q]:
                after[q] = (cost, audit)

        for p, (cost, audit) in best.items():
            offer(p, cost + 4, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            cut = 3 if fault == "truncated" else 0
            for a, q in steps.get(initial, []):
                if a == p:
                    offer(q, cost + cut, audit + "K")
            for role in "ua":
                for a, q in steps[role]:
                    if a == p:
                        offer(q, cost + cut + 3, audit + "R")
        best = put_in(after)
    return min(best[q] for q in (0, 3) if q in best)


def by_exhaustion(codes):
    """(cost, audit) of all edits with at most two turns put in at each place."""
    choices = []
    for initial, fault in codes:
        cut = 3 if fault == "truncated" else 0
        own = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            own += [(cut, "K", initial), (3 + cut, "R", "u"), (3 + cut, "R", "a")]
        choices.append(own)
    gaps = [(0, "", "")] + [(3 * n, "I" * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    found = []
    for picked in itertools.product(*[c for own in choices for c in (gaps, own)], gaps):
        roles = "".join(x[2] for x in picked)
        pairs = roles[1:] if roles.startswith("s") else roles
        if not roles or (pairs and pairs == "ua" * (len(pairs) // 2)):
            found.append((sum(x[0] for x in picked), "".join(x[1] for x in picked)))
    return min(found)


FAULTS = [None, None, "truncated", "blank", "duplicate"]


def test_cells_by_exhaustion():
    rng = random.Random(4)
    for n in (1, 2, 3):
        for _ in range(60):
            codes = [(rng.choice("suat"), rng.choice(FAULTS)) for _ in range(n)]
            assert cheapest(codes) == by_exhaustion(codes)


def test_cells_by_one_pass():
    rng = random.Random(5)
    for _ in range(400):
        codes = [(rng.choice("suuaat "), rng.choice(FAULTS)) for _ in range(rng.randint(1, 40))]
        cells = [repair.ROW_CELLS[i if i in "sua" else "?", f in ("blank", "duplicate"), f == "truncated"] for i, f in codes]
        whole = repair.combine(cells)
        assert min(whole[0, q] for q in (0, 3) if (0, q) in whole) == cheapest(codes)
        # Any split of a span gives the same cell.
        cut = rng.randint(0, len(cells))
        assert repair.join(repair.combine(cells[:cut]), repair.combine(cells[cut:])) == whole


BLANKS = " \t\n\x0b\x0c\r"


def repaired_by_hand(rows):
    """conv: numbers, audit and lines, of rows after damage."""
    out = {}
    for conv, own in in_order([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items():
        seen, codes = set(), []
        for _, _, role, text in own:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            codes.append((role[:1], fault))
        cost, audit = cheapest(codes)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == name for _, f in codes) for name in ("blank", "duplicate", "truncated")]
        illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for (a, _), (b, _) in zip(codes, codes[1:]))
        lines, place, left = [], None, iter(own)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role = "assistant" if place == "u" else "user"
            lines.append(f"{row[2]}:{row[3]}" if edit == "K" else f"{role}:{row[3] if row else ''}")
            place = row[2][0] if edit == "K" else role[0]
        out[conv] = ((gaps, *counts, illegal, cost, audit), lines)
    return out


def talk(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? \n", "cut", "cut off, \t", "", " \x0b", None, "Fine.", "So?"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 12)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [512, 2])
def test_repair(spark, small_tasks, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = talk(6)
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", pos int").repartition(4)
    parsed, lines = repair.repair(spark, frame)
    want = repaired_by_hand(rows)
    assert {r.conv_id: tuple(r)[1:] for r in parsed.collect()} == {c: x for c, (x, _) in want.items()}
    got = {}
    for r in lines.orderBy("pos", "part").collect():
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: x for c, (_, x) in want.items() if x}


def test_a_long_conversation_is_parsed_in_blocks(spark):
    rng = random.Random(7)
    rows = [(1, n, rng.choice(["user", "assistant"]), f"{n}" + rng.choice([".", ""])) for n in range(3000)]
    parsed, lines = repair.repair(spark, spark.createDataFrame(rows, SCHEMA))
    numbers, want = repaired_by_hand(rows)[1]
    assert tuple(parsed.collect()[0])[1:] == numbers
    assert [f"{r.role}:{r.text}" for r in lines.orderBy("pos", "part").collect()] == want


def test_no_conversations(spark):
    parsed, lines = repair.repair(spark, spark.createDataFrame([], SCHEMA))
    assert parsed.count() == lines.count() == 0


def test_query_of_repairs(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in talk(8)] + [(1000 + n, 0, "user", "Hm.") for n in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if kind == 1 else x.translate({ord(m): None for m in ".!?"}) if kind == 2 else x
        damaged += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = repaired_by_hand(damaged)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and len(want) < len(got)
    for conv, found in got.items():
        numbers, lines = want.get(conv, ((0,) * 6 + ("",), []))
        assert found == (*numbers, sha("\n".join(lines)))


def test_folds_take_rows_in_order(spark):
    class Joined:
        def __init__(self):
            self.text = ""

        def add(self, value):
            self.text += value

        def result(self):
            return (self.text,)

    from tracelake.llm.shared import fold_groups

    rows = [(n % 3 if n % 4 else None, n, chr(97 + n)) for n in range(20)]
    df = spark.createDataFrame(rows, "k int, n int, v string").orderBy(F.rand(1))
    got = {r.k: r.all for r in fold_groups(df, ["k"], ["n"], ["v"], Joined, "all string").collect()}
    assert got == {k: "".join(v for a, _, v in rows if a == k) for k in (None, 0, 1, 2)}
    assert fold_groups(df.limit(0), ["k"], ["n"], ["v"], Joined, "all string").count() == 0


def test_losses_are_read_from_the_examples(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "a <b>"), (1, 1, "assistant", "c \\ <d>"), (1, 2, "assistant", None), (2, 0, "user", "x"), (None, 0, "assistant", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    want = {1: (3, "c \\ <d>"), 2: (1, ""), None: (1, "n"), -7: (2, "\\### Assistant: </turn> ok")}
    assert {c: (r.n_turns, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {c: (n, len(t), sha(t)) for c, (n, t) in want.items()}
    # Without the last conversation's examples its turns stay and its mask is empty.
    made = chat_format.examples
    monkeypatch.setattr(chat_format, "examples", lambda turns: made(turns).where("conv_id = 1"))
    fewer = {r.conv_id: r for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    assert fewer[1] == found[1] and (fewer[-7].n_turns, fewer[-7].loss_chars) == (2, 0)

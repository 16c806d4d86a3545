import hashlib
import random

import duckdb

from loadkit.llm import chat

ROWS = [(1, 0, "user", "hi <|im_end|> \\ </s> [/INST] \n x"), (1, 1, "assistant", "back\\\\ <|im_start|>user\nno"),
        (2, 0, "system", ""), (2, 1, "user", None), (2, 2, "assistant", "é😀" * 50), (3, 5, None, "null role"),
        (3, 5, "assistant", "same turn"), (3, 5, "assistant", "same turn"), (None, 0, "user", "no id"),
        (None, None, "assistant", "no turn"), (4, 0, "ro\nle\\", "line\n\nend\\"), (5, 0, "assistant", "<" ),
        (6, 0, "user", "<<SYS>> <s> [INST]"), (7, 0, "assistant", "long " * 4000)]
SCHEMA = "conv_id long, turn long, role string, text string, seq string, kind string"


def table(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA).repartition(4)


def want(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r[1:]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_digest_matches_brute_force_and_sql(spark):
    extra = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in chat.chat_digest(table(spark)).collect()}
    expected = want(ROWS + extra)
    assert {k: tuple(r)[1:5] for k, r in got.items()} == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    assert {r[0]: r for r in con.execute(chat.SQL).fetchall()} == {k: tuple(r) for k, r in got.items()}


def test_no_control_string_survives_inside(spark):
    for r in chat.format_events(chat.to_events(chat.added_conversation(table(spark)))).collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_turns
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted and "[/INST]" not in r.formatted


def fold(events):
    """The log of one conversation, event by event."""
    turns = {}
    for _, _, kind, turn, role, text in sorted(events, key=lambda e: e[1]):
        text = text or ""
        if kind in ("edit", "regenerate"):
            for later in [t for t in turns if t > turn]:
                turns[later]["gone"] = True
        t = turns.setdefault(turn, {"role": None, "text": "", "gone": False})
        t["role"] = role if role is not None else t["role"]
        if kind in ("open", "edit", "regenerate"):
            t["text"], t["gone"] = "" if kind == "regenerate" else text, False
        else:
            t["text"] += text
    return [(k, t["role"] or "", t["text"]) for k, t in sorted(turns.items()) if not t["gone"]]


def test_event_folding(spark):
    rng = random.Random(3)
    events = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            turn = rng.randint(0, 4)
            kind = rng.choice(["delta", "delta", None, "open", "edit", "regenerate"])
            events.append((conv, seq, kind, turn, ("user", "assistant")[turn % 2], rng.choice(["a", "bc", None, "d\n"])))
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {}
    for r in chat.messages(df.repartition(6)).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text))
    for conv in range(40):
        assert sorted(got.get(conv, [])) == fold([e for e in events if e[0] == conv])


def test_empty_log(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_events(chat.to_events(empty)).count() == 0
    assert [r.conv_id for r in chat.chat_digest(empty).collect()] == [-7]


def test_log_has_drafts_edits_and_regenerations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} é😀" * (t % 4)) for c in range(30) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.to_events(table)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["open"] == 180 and min(kinds["edit"], kinds["regenerate"]) > 30
    assert kinds["delta"] > 4 * (180 - kinds["edit"])
    # Without the fold of drafts the texts would differ: a plain concatenation is longer.
    said = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.messages(log).collect()}
    assert said == {(c, t + 1): (role, text) for c, t, role, text in rows}

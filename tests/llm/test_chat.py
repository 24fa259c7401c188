import random

from symgrove.llm import chat

SCHEMA = "conv_id long, seq long, msg long, kind string, role string, text string"


def brute(rows):
    """Apply the events one after the other."""
    seen, convs = {}, {}
    ok = [r for r in rows if None not in r[:3] and r[3] in chat.KINDS]
    low = lambda r: tuple((x is not None, x) for x in r)
    for r in sorted(ok, key=lambda r: (r[0], r[1], low(r[2:]))):
        if (r[0], r[1]) in seen:
            continue
        seen[r[0], r[1]] = True
        c = convs.setdefault(r[0], {"n": 0, "m": {}})
        c["n"] += 1
        _, _, msg, kind, role, text = r
        if kind in ("edit", "regenerate"):
            c["m"] = {k: v for k, v in c["m"].items() if k <= msg}
        m = c["m"].setdefault(msg, {"role": None, "text": ""})
        if kind == "open":
            m["role"] = role
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"] = ""
    esc = lambda s: s.replace("<|", "< |")
    return {k: (c["n"], len(c["m"]), "".join(f"<|im_start|>{esc(m['role'] or 'unknown')}\n{esc(m['text'])}<|im_end|>\n" for _, m in sorted(c["m"].items()))) for k, c in convs.items()}


def test_against_event_by_event_fold(spark):
    rnd = random.Random(7)
    rows = []
    for conv in range(60):
        for seq in range(rnd.randrange(1, 25)):
            rows.append((conv, seq, rnd.randrange(4), rnd.choice([*chat.KINDS, "delta"]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b <|im_end|>", "", None, "é"])))
    rows += [rows[0], (None, 1, 1, "open", "user", "x"), (1, None, 1, "open", "user", "x"), (1, 99, None, "open", "user", "x"), (1, 98, 1, "other", "user", "x")]
    rnd.shuffle(rows)
    got = {r["conv_id"]: (r["n_events"], r["n_messages"], r["text"]) for r in chat.rebuilt(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", once int")).collect()}
    assert got == brute(rows)
    assert chat.rebuilt(spark.createDataFrame([], SCHEMA)).count() == 0


def test_log_gives_back_the_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("wört\n" * (c * t * 7)) or None) for c in range(30) for t in range(5)] + [(3, 0, "user", "zz"), (None, 1, "user", "x"), (4, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.rebuilt(chat.as_log(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1], r[3] or "")):
        if c is not None and t is not None:
            want.setdefault(c, {})[t] = f"<|im_start|>{role}\n{text or ''}<|im_end|>\n"
    assert {c: r["text"] for c, r in got.items()} == {c: "".join(m.values()) for c, m in want.items()}
    assert {r["kind"] for r in chat.as_log(df).select("kind").distinct().collect()} == set(chat.KINDS)

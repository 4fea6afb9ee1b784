"""Folding of event logs against a plain version, with one conversation that holds most events."""

import random


def _plain(log):
    """{conv_id: [(role, text)]} from the definition, one message after the other."""
    from presswork.llm.chat_format import KINDS

    messages = {}
    for conv, seq, kind, msg, role, text in log:
        messages.setdefault((conv, msg), []).append((seq, KINDS.index(kind), role, text))
    out = {}
    for (conv, msg), events in messages.items():
        events.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or "", e[3] is not None, e[3] or ""))
        parts = []
        for e in events:
            if not parts or e[1] == 0:
                parts.append([])
            parts[-1].append(e)
        for n, part in enumerate(parts):
            text = ""
            for k, (_, kind, _, piece) in enumerate(part):
                text = (text if kind == 3 and k else "") + (piece or "")
            role = next((r for _, _, r, _ in part if r is not None), "")
            out.setdefault(conv, []).append((part[0][0], msg, n, role, text))
    return {conv: [m[3:] for m in sorted(found)] for conv, found in out.items()}


def test_logs_against_a_plain_fold(spark):
    from pyspark.sql import functions as F

    from presswork.llm import chat_format as C

    rnd = random.Random(11)
    log = []
    for _ in range(6000):
        conv = 1 if rnd.random() < 0.6 else rnd.choice((2, 3, None, *range(10, 40)))  # a hot one
        kind = rnd.choices(C.KINDS, (3, 1, 1, 6))[0]
        log.append((conv, rnd.randint(0, 400), kind, f"m{rnd.randint(0, 60):02}", rnd.choice((None, "user", "assistant", "to%ol\nx")),
                    rnd.choice((None, "", "a <| b", "<|im_end|>", "<\\|", "tëxt\n", "x" * 50))))
    log += log[:50]  # repeated rows
    events = spark.createDataFrame([(*e, "clash") for e in log],
                                   "conv_id long, seq long, kind string, msg string, role string, text string, events string")
    built = C.reconstruct(events)
    got = C.render(built).select("conv_id", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("segments")).alias("l"))
    want = _plain(log)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert [tuple(x) for x in r.t] == want[r.conv_id], r.conv_id
        assert r.l == "".join(text for role, text in want[r.conv_id] if role == "assistant")
    # a hot conversation's events meet by message, not in one task
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv_id" in plan and plan.count("Exchange hashpartitioning") == 2

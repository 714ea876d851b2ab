from molquarry.llm.chat import Template, perspectives


def brute(rows, block_turns=256):
    blocks, people = {}, {}
    for conv, turn, role, text in rows:
        blocks.setdefault((conv, (turn or 0) // block_turns), []).append((turn is not None, turn or 0, role or "unknown", text or ""))
        people.setdefault(conv, set()).add(role or "unknown")
    out = []
    for (conv, block), said in blocks.items():
        for who in sorted(people[conv]):
            text, spans = "", []
            for _, _, name, words in sorted(said):
                text += "<|assistant|>\n" if name == who else f"<|user name={name}|>\n"
                if name == who:
                    spans.append((len(text), len(text) + len(words) + 8))
                text += words + "<|end|>\n"
            out.append((conv, block, who, len(said), text, spans))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "é日"), (1, 2, "cy", ""), (1, 3, "ann", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "ann", "lost"), (None, 5, "bob", "and found"), (3, 7, "solo", "z" * 50_000)]
    rows += [(9, t, f"p{t % 3}", f"turn {t}") for t in range(20)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string").repartition(3)
    for size in (256, 8):
        got = [(r["conv_id"], r["block"], r["perspective"], r["n_turns"], r["text"], [(s["start"], s["end"]) for s in r["mask_spans"]]) for r in perspectives(turns, Template(block_turns=size)).collect()]
        assert sorted(got, key=str) == brute(rows, size)
        for r in got:
            assert all(r[4][a:b].endswith("<|end|>\n") for a, b in r[5])
    assert perspectives(turns.limit(0)).collect() == []


def test_long_dialogue_is_rendered_whole_for_everyone(spark):
    """600 turns, of which one participant says the first only: it gets all three blocks."""
    rows = [(1, 0, "ann", "start")] + [(1, t, ("bob", "cy")[t % 2], f"turn {t}") for t in range(1, 600)] + [(None, 0, "ann", "a"), (None, 300, "bob", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = perspectives(turns).collect()
    assert sorted(((r["conv_id"], r["block"], r["perspective"], r["n_turns"], r["text"], [(s["start"], s["end"]) for s in r["mask_spans"]]) for r in got), key=str) == brute(rows)
    for who in ("ann", "bob", "cy"):
        own = sorted((r["block"], r["n_turns"]) for r in got if r["conv_id"] == 1 and r["perspective"] == who)
        assert own == [(0, 256), (1, 256), (2, 88)]

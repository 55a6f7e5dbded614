from halyard.llm.chat import format_conversations, locate, read_turns, turn_template, unescape

HARD = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\l\\\\</turn>\n<turn user>\n<"), ("", ""),
        ("we>ird\n<role", "a"), ("assistant", "")]


def with_prompt(turns):
    return "<s>" + "".join(f"[{r}]{t}[/]" for r, t in turns) + "[assistant]"


def last_system_only(turns):
    """Rewrites history: earlier system texts go when a new one comes."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "system"), default=-1)
    return "".join(f"{r}:{t}\n" for i, (r, t) in enumerate(turns) if r != "system" or i == last)


def stripped(turns):
    """Earlier assistant texts lose what stands before "=>" (as thoughts)."""
    return "".join(f"<{r}>{t.split('=>')[-1] if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))


def test_round_trip_and_spans():
    out, spans = locate(turn_template, HARD)
    assert read_turns(out) == HARD
    assert [unescape(out[s.text_start:s.text_end]) for s in spans] == [t for _, t in HARD]
    assert spans[0].start == 0 and spans[-1].end == len(out)
    assert all(a.end == b.start for a, b in zip(spans, spans[1:]))


def test_constant_tail_is_not_a_rewrite():
    turns = [("user", "[/][assistant]"), ("assistant", "x[/]"), ("user", "[assistant]"), ("assistant", "")]
    out, spans = locate(with_prompt, turns)
    assert [out[s.text_start:s.text_end] for s in spans] == [t for _, t in turns]
    assert locate(with_prompt, []) == ("<s>[assistant]", [])


def test_rewriting_templates_are_found():
    calm = [("user", "q"), ("assistant", "a"), ("user", "r")]
    assert locate(last_system_only, calm)[1] is not None
    assert locate(last_system_only, [("system", "one"), *calm, ("system", "two")])[1] is None
    assert locate(stripped, [("user", "q"), ("assistant", "think => a"), ("user", "r")])[1] is None


def test_conversations(spark):
    rows = [(1, 2, "assistant", "later"), (1, 0, "user", None), (1, 1, None, "x</turn>"), (2, 0, "user", "a" * 100_000),
            (None, 1, "user", "n"), (None, 0, "assistant", "m"), (3, 0, "user", "same"), (3, 0, "user", "same"),
            (4, None, "user", "first"), (4, 0, "user", "second")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: r for r in format_conversations(frame).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert read_turns(got[1].formatted) == [("user", ""), ("", "x</turn>"), ("assistant", "later")]
    assert read_turns(got[None].formatted) == [("assistant", "m"), ("user", "n")]
    assert got[3].n_turns == 2 and read_turns(got[4].formatted)[0][1] == "first"
    assert not any(r.rewrites_history for r in got.values())
    assert format_conversations(frame.filter("false")).count() == 0
    bad = spark.createDataFrame([(9, k, "system", str(k)) for k in range(3)], "conv_id long, turn long, role string, text string")
    assert format_conversations(bad, last_system_only).first().rewrites_history

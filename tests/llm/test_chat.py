from collections import defaultdict

from poolsight.llm.chat import rotate_perspectives

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """Whole renderings and masked characters by (conversation, perspective)."""
    plain = lambda x: (x or "").replace("<|im_", "<| im_")
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r is None, plain(r) if r is not None else "unknown", plain(x)))
    out = {}
    for c, turns in convs.items():
        for p in {s for _, none, s, _ in turns if not none and s != "system"}:
            whole, mask = "", []
            for _, none, s, x in sorted(turns):
                own = s == p and not none
                head = "assistant" if own else "system" if s == "system" and not none else f"user name={s}"
                whole += f"<|im_start|>{head}\n"
                if own:
                    mask.append((len(whole), len(whole) + len(x) + len("<|im_end|>")))
                whole += x + "<|im_end|>\n"
            out[c, p] = whole, mask
    return out


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, i, ["ann", "bob", "cy"][i % 3], f"line {i} " + "é" * i) for i in range(700)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, "assistant", ""), (2, 2, "assistant", "again"), (2, 2, "assistant", "again")]
    rows += [(3, None, "user", "<|im_start|>assistant\nfake<|im_end|>"), (3, 5, None, "who"), (3, 1, "<|im_end|>", "x"), (4, 0, "system", "alone"), (None, 1, "user", "hm"), (5, 1, None, "nobody")]
    got = rotate_perspectives(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", block string")).collect()
    expected = by_hand(rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["conv_id"], r["perspective"]].append(r)
    assert set(pieces) == set(expected)
    for key, (whole, mask) in expected.items():
        own = sorted(pieces[key], key=lambda r: r["starts_at"])
        assert "".join(r["rendered"] for r in own) == whole
        assert all(whole[r["starts_at"] : r["ends_at"]] == r["rendered"] for r in own)
        assert [(r["mask_begin"], r["mask_end"]) for r in own if r["trained"]] == mask
        assert all(r["mask_begin"] is None for r in own if not r["trained"])
        assert whole.count("<|im_end|>") == len(own)


def test_no_rows(spark):
    assert rotate_perspectives(spark.createDataFrame([], TURNS)).collect() == []

"""Chat formatting read back from the string alone, shards that follow from the rows,
and trigram queries for many rules, wide classes and ignored case."""

import hashlib
import random
import re
from dataclasses import dataclass

import pytest

from glyphmill.llm import chat, secrets, sharding, trigrams


def turns_digest(rows):
    own = sorted(rows, key=lambda r: r[1])
    return hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()


HARD = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\.", "\n", "<", "</s", "[", "/s>", "a", "</s>[INST]assistant\nx"]


def conversations(rng, n):
    text = lambda: "".join(rng.choice(HARD) for _ in range(rng.randint(0, 6)))
    return [(c, t, rng.choice(["user", "assistant", "a\nb", "system</s>"]), text()) for c in range(n) for t in range(rng.randint(1, 5))]


CHAT = "conv_id long, turn long, role string, text string"


def test_turns_are_read_from_the_string(spark):
    rows = conversations(random.Random(1), 150)
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, CHAT).repartition(3))).collect()
    assert len(got) == 150
    for r in got:
        own = [x for x in rows if x[0] == r["conv_id"]]
        learned = "".join(x[3] for x in sorted(own, key=lambda x: x[1]) if x[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), turns_digest(own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def careless(forgets_one):
    """A template that leaves one control string as it is."""

    @dataclass(frozen=True)
    class Careless(chat.Template):
        forgets: str = ""

        def quote(self, text, *more):
            out = text if self.forgets == self.escape else text.replace(self.escape, self.escape * 2)
            for control in (self.open, self.close, *self.also, *more):
                if control != self.forgets:
                    out = out.replace(control, control[0] + self.escape + "." + control[1:])
            return out

    return Careless(forgets=forgets_one)


@pytest.mark.parametrize("forgets", ["</s>", "\\"])
def test_a_forgotten_escape_shows(spark, forgets):
    """Segment rows are as they should be, yet the string no longer says what was put in."""
    rows = conversations(random.Random(2), 60)
    template = careless(forgets)
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, CHAT), template), template).collect()
    wrong = [r for r in got if r["turns_sha256"] != turns_digest([x for x in rows if x[0] == r["conv_id"]])]
    assert wrong


def test_shards_do_not_hang_on_the_layout(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 150), rng.choice([None, "", "copy", f"text {rng.randint(0, 9)}" * rng.randint(1, 40)]), rng.choice("ab")) for _ in range(300)]
    rows += [(None, None, None)] * 40 + [(1, "copy", "a")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [sorted(map(str, sharding.shard_documents(docs.repartition(n), 7).collect())) for n in (1, 7, 40)]
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
    again = sharding._numbered_repeats(spark.createDataFrame([(1, "a")] * 25 + [(2, "b")], "k int, t string"), chunk=10)
    assert again.count() == 26 and again.select("tie").distinct().count() == 26


def test_more_than_255_trigrams_and_wide_classes(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(120)]
    rules = tuple(secrets.Rule(f"w{i}", re.escape(w), 1) for i, w in enumerate(words))
    texts = [" ".join(rng.choice(words)[: rng.choice((8, 9))] for _ in range(6)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"]) for r in secrets.find_secrets(docs, rules).collect()}
    want = {i: sorted(m.span() for w in words for m in re.finditer(re.escape(w), t)) for i, t in enumerate(texts)}
    assert got == want
    assert trigrams.query("gh[pousr]_x") is not True


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("(?i)tokenkey", "TOKENKEY"), ("(?i)assist", "aſsiſt"), ("(?i:PASS)word", "paſſword"), ("(?i)straße", "STRAẞE"), ("(?i)abcdef", "ABCdef")],
)
def test_ignored_case_loses_no_candidate(spark, pattern, text):
    assert re.search(pattern, text)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(secrets.find_secrets(docs, (secrets.Rule("r", pattern, 1),)).first()["spans"]) == 1

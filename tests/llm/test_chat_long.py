"""One conversation of very many turns: parts and masks that go on over all of it."""

from pyspark.sql import functions as F

from memloom.llm import chat


def test_a_conversation_of_100_000_turns(spark):
    n = 100_000
    role = F.element_at(F.array(*map(F.lit, ("ann", "bob", "system"))), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.rotate(rows)
    got = out.select("part", "perspective", "n_turns", F.length("rendered").alias("size"), F.element_at("masks", 1)["start"].alias("first"), F.element_at("masks", -1)["end"].alias("last"), F.size("masks").alias("own")).collect()
    for name, other in (("ann", "bob"), ("bob", "ann")):
        own = sorted((r for r in got if r.perspective == name), key=lambda r: r.part)
        assert [r.part for r in own] == list(range(-(-n // chat.PART_TURNS))) and sum(r.n_turns for r in own) == n
        opening = {name: "<|assistant|>\n", other: f"<|user name={other}|>\n", "system": "<|system|>\n"}
        at, seen = 0, {}
        for k in range(n):
            who = ("ann", "bob", "system")[k % 3]
            start = at + len(opening[who])
            at = start + len(str(k)) + len(chat.END)
            if who == name:
                first, _, count = seen.get(k // chat.PART_TURNS, (start, 0, 0))
                seen[k // chat.PART_TURNS] = (first, at, count + 1)
        assert [(r.first, r.last, r.own) for r in own] == [seen[r.part] for r in own] and sum(r.size for r in own) == at

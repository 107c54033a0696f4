import random

from impactgraph.llm import toxicity


def test_rare_and_plain_terms_are_searched():
    """Each insult stands in 1 % of the toxic examples; texts without one still have neighbours."""
    r = random.Random(3)
    words = ["".join(r.choice(["ka", "lo", "mi", "ter", "sun"]) for _ in range(4)) for _ in range(300)]
    insults = ["".join(r.choice("bcdfghjkpqvwxz") for _ in range(6)) for _ in range(100)]
    plain = lambda: r.sample(words, 12)
    rows = [(i, " ".join(plain()), 0) for i in range(300)] + [(300 + i, " ".join([*plain(), insults[i % 100]]), 1) for i in range(300)]
    model = toxicity.Model([toxicity.example(*x) for x in rows], (0.1, 1.0))
    bad = [model.score(" ".join([*plain(), insults[i]]), {}) for i in range(50)]
    good = [model.score(" ".join(plain()), {}) for _ in range(50)]
    assert all(e for _, e in bad + good)
    assert sum(s >= 0.7 for s, _ in bad) >= 48 and sum(s < 0.7 for s, _ in good) >= 48

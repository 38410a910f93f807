"""Random words and texts for the tests."""


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def vocabulary(rng, size=400, letters="abcdefghijklmnopqrstuvwxyz"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(size)]

import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(11)
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make

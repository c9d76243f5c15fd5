"""Import cycles of any length against brute force."""

import random

import pytest
from spindrift.operators import rules
from spindrift.operators.index import Index


def brute(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def comes_back(start):
        seen, todo = set(), [x for x in after.get(start, ()) if x != start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(after.get(x, ()))
        return start in seen

    return sorted(f"m{a}.py" for a in after if comes_back(a))


RNG = random.Random(3)
RING = [(i, (i + 1) % 9) for i in range(9)]
GRAPHS = {
    "four": [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (0, 1), (6, 6)],
    "nine and a bridge to two": [*RING, (3, 20), (20, 21), (21, 30), (30, 31), (31, 30), (40, 0)],
    "none": [(1, 2), (2, 3), (1, 3)],
    "random": [(RNG.randrange(30), RNG.randrange(30)) for _ in range(36)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_cycles_of_any_length(spark, name):
    edges = GRAPHS[name]
    nodes = sorted({x for e in edges for x in e})
    files = spark.createDataFrame([(i, f"m{i}.py") for i in nodes], "file_id long, rel_path string")
    imports = spark.createDataFrame([(a, f"m{b}") for a, b in edges], "file_id long, module string")
    found = rules.import_cycles(Index(files, None, None, None, imports, None)).collect()
    assert [r["rel_path"] for r in found] == sorted(brute(edges))

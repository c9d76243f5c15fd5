"""The steps of a prediction are those of training, in less time."""

import time
import warnings

import numpy as np
from spindrift.llm import langid


def test_a_walk_is_the_step_of_training():
    rng = np.random.default_rng(3)
    for scale in (1, 500):  # 500: arguments that exp cannot hold
        model = langid.ByteTagger(["a", "b", "c"])
        model.p = {k: v * np.float32(scale) for k, v in model.p.items()}
        for d in "fb":
            h, walk = np.zeros((40, model.hidden), np.float32), model._walker(d, 40)
            for n in (40, 40, 33, 7):
                x = rng.integers(0, 256, n)
                want = model._step(d, x, h[:n])[0]
                with warnings.catch_warnings(), np.errstate(over="ignore"):
                    warnings.simplefilter("error")
                    walk(x, h[:n])
                assert np.allclose(h[:n], want, atol=2e-6)
                h[:n] = want


def test_a_prediction_takes_less_time_than_the_steps_of_training():
    model, rng = langid.ByteTagger(["a", "b", "c", "d"]), np.random.default_rng(4)
    texts = [bytes(rng.integers(32, 127, 3000, dtype=np.uint8)) for _ in range(100)]
    x = rng.integers(32, 127, (96, 3125))

    def steps():
        for d in "fb":
            h = np.zeros((3125, model.hidden), np.float32)
            for t in range(96):
                h = model._step(d, x[t], h)[0]

    def seconds(run):
        times = []
        for _ in range(3):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert seconds(lambda: model.probabilities(texts)) < 0.85 * seconds(steps)

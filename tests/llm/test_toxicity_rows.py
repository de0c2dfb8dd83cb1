import inspect

import numpy as np

from leafmill.llm import toxicity


def test_ten_thousand_rows_a_class_teach():
    assert inspect.signature(toxicity.train).parameters["max_rows"].default == 10_000


def test_rows_without_features_and_changes():
    one, none = np.ones(1, np.int32), np.zeros(0, np.int32)
    w, bias = toxicity.fit(np.array([1, 0, 1, 0]), np.array([0, 0], np.int32), np.array([1.0, 0, 1, 0]), np.full(4, 0.25), np.zeros(0, np.int64), none, none, 2, 1e-3, 1.0)
    assert w[0] + bias > 0 > bias
    held, _ = toxicity.fit(np.array([1, 0]), np.array([0], np.int32), np.array([1.0, 0]), np.full(2, 0.5), np.array([1]), np.array([0], np.int32), one.astype(np.int8), 2, 1e-3, 100.0)
    assert abs(held[0]) < 0.1

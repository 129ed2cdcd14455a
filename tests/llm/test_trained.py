"""Models made in a task."""

import numpy as np

from lagloom.llm import quality, toxicity
from lagloom.llm.common import table
from lagloom.llm.labelled import sample, trained


def test_models_equal_those_of_the_driver(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    for label, fit in (("quality", quality.fitted), ("toxic", toxicity.train)):
        got, want = trained(docs, labels, label, 30, fit), fit(sample(docs, labels, label, 30))
        assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(got, want, strict=True))
        assert all(np.allclose(a, b) for a, b in zip(trained(docs, labels.limit(0), label, 30, fit), fit([]), strict=True))

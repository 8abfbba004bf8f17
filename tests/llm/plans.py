"""What the plans of a job shuffle."""

import re

from pyspark.sql import DataFrameWriter


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def watch_writes(monkeypatch):
    """A list that collects the plan of every table written from now on."""
    seen = []

    def spy(self, *args, _plain=DataFrameWriter.parquet, **more):
        seen.append(explained(self._df))
        return _plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return seen


def shuffled(plans):
    """The columns of every exchange, broadcasts left out, as text."""
    return [line for text in plans for line in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", text)]

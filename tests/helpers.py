"""What several test files use. Not in a conftest: files of that name in subfolders hide each other."""


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def plan(frame, mode="formatted"):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )

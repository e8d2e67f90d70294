"""Reading physical plans in tests."""


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

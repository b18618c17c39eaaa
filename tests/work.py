"""How many rows the operators of a query make."""


def most_rows(spark, run) -> int:
    """The most rows that one operator put out in the SQL executions that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, executions = [0], store.executionsList()
    for k in range(min(before, executions.size()), executions.size()):
        execution = executions.apply(k)
        values = store.executionMetrics(execution.executionId())
        for i in range(execution.metrics().size()):
            metric = execution.metrics().apply(i)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                found.append(int(values.apply(metric.accumulatorId()).split("\n")[-1].split("(")[0].replace(",", "")))
    return max(found)

"""attrition: subscription-loss analytics as Spark DataFrame operators.

Entry points:

* ``attrition.plans.datasets``  the four datasets (losses by module / plan,
  loss detail, active base) as ``DataFrame -> DataFrame`` functions;
* ``attrition.plans.reports``   report frames built on them;
* ``attrition.plans.page.LossPage``  the whole report, sharing work;
* ``attrition.plans.sql``       the same flagship query through ``spark.sql``;
* ``python -m attrition``       batch job writing the datasets.

Inputs are ``contracts`` and ``clients`` DataFrames with the schemas of
``attrition.sources.tables``; ``as_of`` and the window are parameters.
"""

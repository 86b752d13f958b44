"""Documents don't depend on how rows are dealt to tasks."""

import json

from tagloom.model import ROLES
from tagloom.plans import queries as plans
from tagloom.sources import sinks


def test_roles_in_their_own_order(spark):
    allowed = spark.createDataFrame([("shop=a",)], "tag_id string")
    for rows in (plans.role_rows(spark), plans.role_rows(spark).orderBy("role", "key"), plans.role_rows(spark).repartition(7, "key")):
        doc = json.loads(sinks.slim_allowlist(rows, allowed).first().document)
        assert list(doc["roles"].items()) == list(ROLES.items())
    rows = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "z")], "key string, role string")
    assert list(json.loads(sinks.slim_allowlist(rows, allowed).first().document)["roles"]) == ["a", "b", "c"]

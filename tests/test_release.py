"""What an application writes for itself goes when it is released."""

import os

from scorelens import session
from scorelens.plans import views as V
from scorelens.plans.helpers import checkpoint
from scorelens.sources import io

from conftest import SF_SMALL


def test_release_deletes_all_and_views_are_built_again(spark):
    V.w1(spark, SF_SMALL).count()
    checkpoint(spark.range(3))
    io.write_csv_result(spark.range(3), io.output_root(spark, "csv"))
    root = session.tables_root(spark).removeprefix("file:")
    assert len(os.listdir(root)) >= 3
    session.release_tables(spark)
    assert not os.path.exists(root)
    assert V.w1(spark, SF_SMALL).count() > 0

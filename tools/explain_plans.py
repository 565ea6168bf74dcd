"""Print the formatted physical plans of the main non-model queries.

usage: python tools/explain_plans.py [data_dir] [name ...]
"""

import sys

sys.path.insert(0, ".")
from grove.plans.queries import QUERIES  # noqa: E402
from grove.session import local_session  # noqa: E402

DEFAULT = ["confusion_matrix", "cohen_kappa", "regression_metrics", "holdout_split",
           "fold_assignment", "dataset_profile", "class_weights", "index_labels",
           "classification_report", "preview", "assemble_features"]

if __name__ == "__main__":
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or DEFAULT:
        print(f"==================== {name}")
        QUERIES[name](spark, data_dir).explain("formatted")

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from basketry.plans.incremental import update_patterns
from basketry.plans.miner import mine
from basketry.queries import CUST_BRAND, FUP, ITEMSETS, ORDER_BRAND, cust_brand, order_brand, order_brand_parts
from basketry.session import staged

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["q01_item_support", "q04_vertical_words", "q08_pairwise_support", "q12_frequent_k3", "q12b_frequent_k3_bitmap", "q12c_frequent_k3_arrow", "q14_mine_full_cust_brand", "q19_fup_merged"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ITEMSETS["q14_mine_full_cust_brand"](spark, SF_DIR).count()  # warm-up
    times = {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: ITEMSETS[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    timed("mine_order_brand", lambda: mine(order_brand(spark, SF_DIR), ORDER_BRAND).total)
    old, new = (staged(part, "part") for part in order_brand_parts(spark, SF_DIR))
    l_old, l_new = (staged(mine(part, FUP).itemsets(), "stored") for part in (old, new))
    timed("update_stored_patterns", lambda: update_patterns(l_old, l_new, old, new, FUP).write.format("noop").mode("overwrite").save())
    timed("mine_union_anew", lambda: mine(old.unionByName(new), FUP).total)
    if os.environ.get("BENCH_FPGROWTH"):
        from pyspark.ml.fpm import FPGrowth
        from pyspark.sql import functions as F

        for name, baskets, share in (("fpgrowth_cust_brand", cust_brand, CUST_BRAND), ("fpgrowth_order_brand", order_brand, ORDER_BRAND)):
            sets = baskets(spark, SF_DIR).groupBy("tid").agg(F.collect_list("item").alias("items"))
            timed(name, lambda sets=sets, share=share: FPGrowth(minSupport=float(share)).fit(sets).freqItemsets.write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Search of arriving sequences against a saved signature table."""

from pyspark.sql import DataFrame

from sigloom.plans.compare import ComparePlan
from sigloom.session import cut_lineage, is_written, release


def search_stream(contigs: DataFrame, saved: DataFrame, plan: ComparePlan, out_path, checkpoint, available_now=False):
    """Compare every micro-batch of ``genome_id, seq`` with ``saved`` and append the pairs to ``out_path``.

    A genome has to arrive within one batch.  Each batch is written to its own folder, which a replay after a failure
    overwrites, so every pair is there exactly once.
    """
    known = saved if is_written(saved) else cut_lineage(saved)

    def compare(batch: DataFrame, batch_id: int):
        asked = plan.prepare(plan.signature.build(batch.select("genome_id", "seq")))
        job = plan.job(known, asked)
        job.pairs().write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        job.release()
        release(asked)

    writer = contigs.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Operations of a training-data pipeline over text corpora.

Every operator takes and returns DataFrames. Whatever has to outlive one job
(token tables, archives, edge tables) is written below the folder that
``spark.checkpoint.dir`` names, which driver and executors share.
"""

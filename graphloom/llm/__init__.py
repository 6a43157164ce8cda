"""Operations of a training-data pipeline over the ``documents`` table.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

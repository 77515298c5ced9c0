"""Operators for preparing training data at scale: tokens, filters, de-duplication, scans and scoring of documents.

Common to all of them, unless an operator says otherwise: a null text is an empty one; a null ``doc_id`` is an id like any
other and sorts first; repeated rows are judged one by one; columns that an operator does not name are ignored, or carried
along where it returns the documents themselves; an empty table gives an empty result with the same columns.
"""

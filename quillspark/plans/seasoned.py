"""A view over documents in which every tell occurs: the same statement in any engine."""

SEASONED = """
SELECT doc_id, lang, source,
  CASE WHEN doc_id % 97 = 13 THEN '' WHEN doc_id % 97 = 14 THEN 'Too short.' ELSE concat(text,
    CASE WHEN doc_id % 2 = 0 THEN ' The plan — such as it is — holds.' ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN ' Moreover, we leverage robust tools and delve into a tapestry.' ELSE '' END,
    CASE WHEN doc_id % 4 = 1 THEN ' It is important to rest. It is often late. It is common here.' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN ' “Fine,” they said, ‘really’.' ELSE '' END,
    CASE WHEN doc_id % 6 = 1 THEN ' In other words, it works. Put simply, it holds.' ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN ' The route is not just short but safe.' ELSE '' END,
    CASE WHEN doc_id % 8 = 3 THEN ' Red, green, and blue. Bread, butter, and jam. Thé, café, and été.' ELSE '' END,
    CASE WHEN doc_id % 9 = 2 THEN ' Dr. Smith of the U.S. team paid 3.5 percent.Next came W. Brown.' ELSE '' END,
    CASE WHEN doc_id % 11 = 0 THEN concat(' In today', chr(39), 's rush, unlock it.') ELSE '' END) END AS text
FROM documents
"""

"""Training-data operators: archives, scoring, deduplication, mixing, packing.

Each module holds one operator with its own general interface;
:mod:`corpusloom.llm.queries` applies them to the tables of a data folder.
Nothing outside this folder imports it.
"""

"""Training-data operators: url filters, classifiers, search, packing, sharding, sketches and mixing.

Nothing outside this folder imports it.
"""

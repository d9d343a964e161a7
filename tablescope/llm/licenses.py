"""Licence scan: known notices found in documents by MinHash bands over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windowhash

#: Published wording of common licence notices, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-2-Clause-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def templates(spark: SparkSession, wording: dict[str, str] | None = None) -> DataFrame:
    """``item_id, license, text`` of the templates, numbered in the order of their names."""
    named = sorted((wording or TEMPLATES).items())
    return spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(named)], "item_id long, license string, text string")


def scan(docs: DataFrame, known: DataFrame, threshold: float = windowhash.CONTAINED) -> DataFrame:
    """``doc_id, license, n_shared, n_template, containment`` for every notice found in a document.

    See ``windowhash.contained`` for NULLs, short templates and repeated ids.
    """
    found = windowhash.contained(docs, known, threshold)
    return found.join(known.select("item_id", "license"), "item_id").select(
        "doc_id", "license", "n_shared", F.col("n_item").alias("n_template"), "containment"
    )

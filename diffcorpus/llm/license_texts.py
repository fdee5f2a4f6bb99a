"""Licence templates: name, words of the text or notice, and phrases that must stand in it."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    name: str
    text: str
    phrases: tuple[str, ...]


#: Phrase -> label: the base that every scan reports.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words that tell no licence from other prose.
STOP = frozenset(
    "a all an and any are as at be by for from has have he in is it its not of on or other shall such that the their these this those to under was were which who will with without you your".split()
)

#: Public licence notices and opening passages.
TEMPLATES = (
    Template("mit-notice", "Released under the MIT License", ("mit license",)),
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("lgpl-notice", "Licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl-notice", "Licensed under the GNU Affero General Public License", ("affero general public license",)),
    Template("cc-by-4.0-notice", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use", "above copyright notice"),
    ),
    Template(
        "apache-2.0-text",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        ("in compliance with the license", "required by applicable law"),
    ),
    Template(
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("free software", "gnu general public license"),
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use", "with or without fee"),
    ),
    Template(
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("unencumbered software", "public domain"),
    ),
)

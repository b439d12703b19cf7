"""License texts and headers without the license's name, and SPDX expressions."""

import pytest

from tradelens.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
BSD = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted. Redistributions in binary form must reproduce the notice."
GNU = "you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; {}"


TEXTS = [
    (MIT, ["mit"]), ("Permission is hereby granted, free of charge", ["mit"]), (MIT.replace("in the Soft", "with the Soft"), ["ncsa"]),
    (ISC + ", provided that the above\ncopyright notice", ["isc"]), (ISC + ".", ["0bsd"]),
    ("Redistribution and use in source and binary forms", ["bsd"]), (BSD, ["bsd-2-clause"]),
    (BSD + "\n# Neither the name of the", ["bsd-3-clause"]), (BSD + " All advertising materials mentioning features. Neither the name of", ["bsd-4-clause"]),
    (GNU.format("", "either version 3 of the License, or\n * (at your option) any later version."), ["gpl-3.0-or-later"]),
    (GNU.format("", "version 2 of the License."), ["gpl-2.0-only"]),
    (GNU.format("Lesser ", "either version 2.1 of the License, or (at your option) any later version."), ["lgpl-2.1-or-later"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable", ["zlib"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["gpl-2.0-only"]), ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1-or-later"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["gpl-2.0-or-later"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["mit", "apache-2.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0 */", ["mit", "apache-2.0"]), ("SPDX-License-Identifier: MIT and more words", ["mit"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND (ISC OR BSD-3-Clause)", ["gpl-2.0-only", "isc", "bsd-3-clause"]),
    ("permission is granted to redistribute forms", []),
    # abbreviations
    ("Licensed under the GNU GPL v3", ["gpl-3.0"]), ("GPLv3", ["gpl-3.0"]), ("Released under GPL v2 or later", ["gpl-2.0-or-later"]), ("GPL-2.0-only code", ["gpl-2.0-only"]),
    ("this is GPLv2+ code", ["gpl-2.0-or-later"]), ("LGPL version 2.1", ["lgpl-2.1"]), ("LGPLv3, or any later version", ["lgpl-3.0-or-later"]), ("under the AGPLv3.", ["agpl-3.0"]),
    ("Licensed under the EUPL", ["eupl"]), ("EUPL v1.2", ["eupl-1.2"]), ("MPL 2.0", ["mpl-2.0"]), ("the file is under the MPL.", ["mpl"]), ("EPL-2.0", ["epl-2.0"]), ("CDDL 1.1", ["cddl-1.1"]),
    ("This library is GPL licensed", ["gpl"]), ("under the terms of the LGPL", ["lgpl"]), ("CC0", ["cc0-1.0"]), ("CC BY-SA 4.0", ["cc-by-sa-4.0"]), ("CC-BY-NC-ND 3.0", ["cc-by-nc-nd-3.0"]),
    # keys, badges and plain words
    ("License: MIT", ["mit"]), ('license = "Apache-2.0"', ["apache-2.0"]), ("'license': 'BSD-3-Clause',", ["bsd-3-clause"]), ("licence: GPLv3", ["gpl-3.0"]), ("License: GPL v2", ["gpl-2.0"]),
    ("License: MIT OR Apache-2.0", ["mit", "apache-2.0"]), ("license => proprietary", ["proprietary"]), ("![x](https://img.shields.io/badge/license-MIT-blue.svg)", ["mit"]),
    ("badge/License-Apache%202.0-green", ["apache-2.0"]), ("badge/license-BSD--3--Clause-orange", ["bsd-3-clause"]), ("This project is MIT licensed.", ["mit"]), ("a BSD-licensed port", ["bsd"]),
    ("All rights reserved. Proprietary", ["proprietary"]), ("Proprietary and confidential.", ["proprietary"]), ("Unauthorized copying of this file, via any medium is strictly prohibited", ["proprietary"]),
    # products, prose and other words are none
    ("released under Ruby on Rails", []), ("provided under PHP 8", []), ("available under Python 3", []), ("released under the Elastic band", []), ("distributed under Vim", []),
    ("released under the PHP License", ["php-3.01"]), ("Elastic License 2.0", ["elastic-2.0"]), ("available under the Ruby license", ["ruby"]),
    ("a driving license: see the office", []), ("License: see the file", []), ("I gpl2x it", []), ("all rights reserved", []), ("his license expired; limits were committed", []), ("the simpl 3 epl8 model", []),
    # a BSD text with a long preamble keeps its clauses, and two texts keep their own
    (BSD.split(" Redis")[0] + "." + " filler words" * 400 + " Redistributions in binary form must reproduce" + " more" * 900 + " Neither the name of X", ["bsd-3-clause"]),
    (BSD + "\nNeither the name of Y. " + BSD, ["bsd-3-clause", "bsd-2-clause"]),
]


@pytest.mark.parametrize(("text", "labels"), TEXTS)
def test_license_texts(text, labels):
    assert [d.label for d in licenses.detect(text)] == labels

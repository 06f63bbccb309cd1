"""Wording of licences and their notices by family, names by which they are announced, and look-alikes.

The paragraphs are those of the public licence texts, or the notices that these texts tell authors to attach.
"""

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "You are free to share and adapt the material for any purpose, even commercially. You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "You may not use the material for commercial purposes.",
    ],
    "Public-Domain": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
    ],
}

#: Names by which a family is announced.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT license", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-3.0-or-later", "GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "LGPLv3", "LGPL-2.1", "LGPL-2.1-or-later", "GNU LGPL", "GNU Lesser General Public License"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "GNU AGPL"],
    "BSD": ["BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "New BSD License", "Simplified BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC license", "ISC"],
    "CC-BY": ["CC BY 4.0", "CC BY-SA 4.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "Public-Domain": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Unlicense"],
}

#: Licences of no family above: those that the unknown class is trained on, and those that only calibrate it.
OTHERS = ["Eclipse Public License", "zlib License", "Artistic License 2.0", "Microsoft Public License", "PostgreSQL License", "Academic Free License", "EPL-2.0", "AFL-3.0", "Open Software License", "NCSA", "Sleepycat License", "Vim License"]
UNSEEN = ["Boost Software License", "European Union Public Licence", "EUPL-1.2", "SIL Open Font License", "Common Development and Distribution License", "CDDL-1.0", "BSL-1.0", "Python Software Foundation License", "Foobar Community License", "OFL-1.1"]

#: Announcements, {} being a name: those that are trained on, and those that only calibrate.
SAID = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "SPDX-License-Identifier: {}", "Distributed under the {}.",
    "License: {}", "The source code is available under the {}.", "This file is part of a program licensed under the {}.", "See the {} for details.", "You may use this software under the terms of the {}.",
]
SAID_OTHERWISE = ["This software is distributed under the terms of the {}.", "The code is released under {}.", "Published under the {}.", "All code in this repository is licensed under the {}, see below.", "It is made available under the {}."]

#: Sentences that share words with licences and are none.
DECOYS: list[str] = [
    "She lost her driver's license on the way to the airport.",
    "The public library is open to the general public on Sundays.",
    "Version 3 of the game was released under the supervision of the new team.",
    "The plumber is licensed and insured in the state.",
    "He asked for permission to use the kitchen and to copy the recipe.",
    "All seats reserved for members of the general assembly.",
    "The software is free and easy to use on any computer.",
    "Human rights and civil rights were the topic of the lecture.",
    "The foundation published a copy of the report along with the terms of the agreement.",
    "Creative work is common in this department.",
    "The patent office granted the request without any fee or restriction.",
    "Public domain names are sold by many companies.",
    "The conditions of the road were bad and the warranty of the car had ended.",
    "This file contains the list of names used in the following chapter.",
    "The town may not use this land except in an emergency.",
    "The album was released under the label's new name in March.",
    "A licensed professional should see the manual for details.",
    "This building is part of a larger program of the city.",
    "The terms of the contract were made available to the public.",
    "You can find more in the license office next to the general store.",
    "The author is free to change the source of the story.",
    "The report was distributed to all members under the terms agreed.",
    "Mit der Lizenz in der Tasche fuhr er los.",
    "Die Software ist mit dem Vertrag lizenziert worden.",
]

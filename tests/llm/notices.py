"""Licence notices written by hand: (family, text), and texts that name no family told apart here."""

#: Known notices; the templates were widened with these in view.
CASES = [
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0+"),
    ("GPL", "Licensed under the GNU GPL, version 2."),
    ("GPL", "This module is released under the GPLv3 or later."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL", "Licensed under the LGPL v2.1."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ('MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "This is licensed under MIT."),
    ("MIT", "The code is available under the MIT license, see below."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "License: MIT"),
    ('Apache-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ('Apache-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "This project is distributed under the terms of the Apache-2.0 license."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "Released under the 3-clause BSD license."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA", "Content is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA", "Photo: CC BY-SA 3.0, via the commons"),
    ("CC-BY-NC", "This is an open access article under the CC BY-NC license."),
    ("CC-BY-NC", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("public-domain", "SPDX-License-Identifier: CC0-1.0"),
    ("public-domain", "SPDX-License-Identifier: Unlicense"),
    ("proprietary", "Copyright (c) 2019 Acme Corporation. All rights reserved."),
    ("proprietary", "This source code is confidential and proprietary; unauthorized copying of this file, via any medium, is strictly prohibited."),
]

UNKNOWN = [
    'SPDX-License-Identifier: EPL-2.0',
    'Eclipse Public License 2.0',
    'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    'Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");',
    'SPDX-License-Identifier: EUPL-1.2',
    'SPDX-License-Identifier: Zlib',
    'Licensed under the Academic Free License version 3.0',
    'Distributed under the Boost Software License, Version 1.0.',
    'This software is provided under the Common Development and Distribution License.',
    'Licensed under the Artistic License 2.0.',
    'SPDX-License-Identifier: BSL-1.0',
    'SPDX-License-Identifier: WTFPL',
    "The driver's licence was taken away by the police after the accident.",
    'All her rights were reserved by the court until the next hearing.',
    'The general public was not allowed to enter the building.',
    'He asked for permission to use the copy machine in the public library.',
    'The warranty of the car ended in spring and the software was free.',
    'Copyright is a complicated matter in the digital age.',
]

#: Written after the templates were settled.
LATER = [
    ("MIT,Apache-2.0", "This crate is dual-licensed under the MIT license or the Apache License, Version 2.0, at your option."),
    ("proprietary", "(c) 2021 Northwind Ltd, all rights reserved."),
    ("GPL", "You may redistribute it under the terms of the GNU GPL version 3 as published by the FSF."),
    ("public-domain", "The data set is dedicated to the public domain under CC0."),
    ("GPL", "This file is part of Fooplot, which is free software under the GNU General Public License."),
    ("MPL", "Available under the Mozilla Public License 1.1."),
    ("MIT", "It is MIT licensed."),
    ("Apache-2.0", "The Apache License 2.0 applies to all files here."),
    ("BSD", "The library is BSD licensed."),
    ("LGPL", "Linking is allowed under the GNU LGPL version 3."),
    ("CC-BY", "Figures are reproduced from an open access paper (CC BY 4.0)."),
    ("CC-BY-SA", "Map data and text: Creative Commons Attribution-ShareAlike licence."),
    ("CC-BY-NC", "Recordings may be shared under CC BY-NC-ND 4.0."),
    ("AGPL", "The server is released under the GNU Affero General Public License v3."),
    ("ISC", "Licensed under the ISC License, see LICENSE."),
]

LATER_UNKNOWN = [
    "Source is available under the Elastic License 2.0.",
    "The database uses the Server Side Public License.",
    "This is the beerware licence: do as you like.",
    "The JSON license asks you to do good.",
    "A new edition appeared under licence from the publisher; the copyright remains with the heirs.",
    "They were granted permission to use the hall free of charge.",
    "SPDX-License-Identifier: Elastic-2.0",
    "Licence to crenellate was granted by the king in 1340.",
]

#: Short notices that were reported as missed; the names and frames were written with these in view.
SHORT = [
    ("MIT", "The code is MIT licensed."),
    ("Apache-2.0", "Distributed under the Apache License 2.0; see LICENSE."),
    ("BSD", "released under the new BSD license"),
    ("GPL", "GPLv3 or later"),
    ("LGPL", "Released under LGPL 2.1"),
    ("MPL", "Code is under MPL-2.0."),
    ("MIT,Apache-2.0", "license: MIT OR Apache-2.0"),
]

#: Written after names and frames were settled, before they were run on these.
SHORT_LATER = [
    ("MIT", "Copyright 2020 by the authors, MIT license."),
    ("MIT", "Everything in this folder is provided under the MIT licence."),
    ("Apache-2.0", "Apache 2.0 licensed, contributions welcome."),
    ("Apache-2.0", "You may use the model weights under the Apache 2.0 license."),
    ("GPL", "The plugin is GPLv2 or later, like the host program."),
    ("GPL", "This tool is published under GNU GPL v3."),
    ("LGPL", "The bindings are LGPLv3 licensed."),
    ("LGPL", "Dynamic linking is fine under the terms of the LGPL license."),
    ("AGPL", "The hosted version is available under AGPLv3."),
    ("BSD", "Available under the 2-clause BSD license."),
    ("BSD", "This port is under the modified BSD licence."),
    ("MPL", "The extension is available under the MPL 2.0 license."),
    ("ISC", "ISC licensed."),
    ("CC-BY", "Text is licensed under CC BY 4.0."),
    ("CC-BY-SA", "All photographs: CC BY-SA 4.0."),
    ("CC-BY-NC", "The course notes are released under CC BY-NC 4.0."),
    ("public-domain", "The data is released under CC0."),
    ("MIT,GPL", "Dual licensed MIT or GPL."),
    ("BSD,GPL", "You can choose: licensed under BSD 3-clause or GPL v2."),
    ("proprietary", "Internal use only. All rights reserved."),
]

SHORT_UNKNOWN = [
    "Released under the Zope Public License.",
    "The dataset is available under the Open Database License.",
    "Licensed under the EPL 2.0.",
    "Distributed under the zlib license.",
    "The car is licensed to carry four passengers.",
    "He works at MIT or at Harvard, under licence from nobody.",
    "The Apache helicopter was licensed for production abroad.",
    "Under the terms of the same license, 2 0 copies were sold.",
    "Wir fahren mit oder ohne Lizenz, license or not.",
    "The later edition is licensed by the publisher.",
]

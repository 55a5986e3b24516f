"""License scans by sentence rules.

Texts are cut into sentences and normalised; sentences that are known are
replaced by their identifiers, and the sequence of identifiers of a document
is matched against ordered rules, one or more for each licence.  The first
rule that matches takes its sentences: a text of the three-clause BSD licence
holds the sentences of the two-clause one, too, but isn't reported as both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licences and licence notices, by identifier, each as a text is cut:
#: "v. 2.0" is cut after the first mark.
SENTENCES = {
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-released": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-file": "This file is licensed under MIT.",
    "MIT-code": "This code is licensed under the MIT license.",
    "Dual-Apache-MIT": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    "Dual-MIT-Apache": "This project is dual-licensed under the MIT license and the Apache License, Version 2.0.",
    "Dual-MIT-Apache-short": "Dual licensed under MIT or Apache-2.0.",
    "MIT-project": "This project is licensed under the MIT License.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-licensed": "Released under the BSD License.",
    "Apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "Apache-comply": "you may not use this file except in compliance with the License.",
    "Apache-obtain": "You may obtain a copy of the License at",
    "Apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "Apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "GPL-free": "This program is free software:",
    "GPL-v2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "GPL-v3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "GPL-terms-v2": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-terms-v3": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "GPL-terms-only-v2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.",
    "GPL-terms-only-v3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "GNU-or-later-1": "either version 1 of the License, or (at your option) any later version.",
    "GNU-or-later-2": "either version 2 of the License, or (at your option) any later version.",
    "GNU-or-later-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "GNU-or-later-3": "either version 3 of the License, or (at your option) any later version.",
    "GNU-only-2": "version 2 of the License.",
    "GNU-only-2-dated": "version 2 of the License only.",
    "GNU-only-3": "version 3 of the License.",
    "GPL-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-details": "See the GNU General Public License for more details.",
    "GPL-received": "You should have received a copy of the GNU General Public License along with this program.",
    "GPL-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "GPL-preamble-v2": "The licenses for most software are designed to take away your freedom to share and change it.",
    "GPL-preamble-v3": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "GNU-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-free": "This library is free software;",
    "LGPL-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "LGPL-terms-library": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation;",
    "LGPL-v2.1": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-v3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "LGPL-details": "See the GNU Lesser General Public License for more details.",
    "LGPL-received": "You should have received a copy of the GNU Lesser General Public License along with this library;",
    "LGPL-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-v3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-terms-v3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation.",
    "AGPL-details": "See the GNU Affero General Public License for more details.",
    "AGPL-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "AGPL-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "FDL-permission": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "FDL-permission-1.2": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation;",
    "FDL-sections": "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GPL-work-v3": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-licensed": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-licensed": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "MPL-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-incompatible": 'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v.',
    "MPL-1.1-subject": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "MPL-1.1-basis": 'Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied.',
    "MPL-1.1-rights": "See the License for the specific language governing rights and limitations under the License.",
    "EPL-1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "EPL-2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "EPL-2-available-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v.",
    "CDDL-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "EUPL-licensed": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "EUPL-comply": "You may not use this work except in compliance with the Licence.",
    "Artistic-terms": "you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "Artistic-freedom": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not permitted.",
    "Artistic-preamble": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "Perl-same": "you can redistribute it and/or modify it under the same terms as Perl itself.",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-claim": "you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-remove": "This notice may not be removed or altered from any source distribution.",
    "BSL-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "BSL-notices": "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "PostgreSQL-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "HPND-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "WTFPL-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "OFL-licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "OFL-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions:",
    "OFL-sold": "Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.",
    "UPL-grant": 'Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the "Software"), free of charge and under any and all copyright rights in the Software, and any and all patent rights owned or freely licensable by each licensor hereunder covering either (i) the unmodified Software as contributed to or provided by such licensor, or (ii) the Larger Works (as defined below), to deal in both',
    "0BSD-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "ISC-use": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-licensed": "Licensed under the ISC License.",
    "BSD-endorse-author": "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-endorse-holders": "Neither the names of the copyright holders nor the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-endorse-name": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-disclaimer-author": 'THIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-disclaimer-regents": 'THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-damages": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    "BSD-damages-author": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    "BSD-loss": "LOSS OF USE, DATA, OR PROFITS;",
    "BSD-loss-theory": "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-licensed": "Licensed under the BSD 2-Clause License.",
    "BSD-3-licensed": "Licensed under the BSD 3-Clause License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at",
    "MIT-style-file": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "Apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "Apache-foundation": 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.',
    "Apache-asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");',
    "Apache-project": "This project is licensed under the Apache License 2.0.",
    "Apache-released": "Released under the Apache License, Version 2.0.",
    "GPL-project-v3": "This project is licensed under the GNU General Public License v3.0.",
    "GPL-project-v2": "This project is licensed under the GNU General Public License v2.0.",
    "GPL-licensed-v3": "Licensed under the GNU General Public License v3.0.",
    "GPL-licensed-v2": "Licensed under the GNU General Public License v2.0.",
    "AGPL-project": "This project is licensed under the GNU Affero General Public License v3.0.",
    "MPL-licensed": "Licensed under the Mozilla Public License 2.0.",
    "Unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-dedicate": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "CC-BY-3-work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND": "Licensed under CC BY-NC-ND 4.0.",
    "CC-text-available": "Text is available under the Creative Commons Attribution-ShareAlike License;",
    "CC0-dedicated": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Ordered rules: a licence is found where these sentences follow one another, others between them or not.
#: The first rule that matches takes its sentences, so a rule stands before those that need only a part of its sentences.
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty"]),
    ("MIT-0", ["MIT-0-grant", "MIT-warranty", "MIT-liability"]),
    ("MIT-0", ["MIT-0-grant", "MIT-warranty"]),
    ("MIT", ["MIT-released"]),
    ("MIT", ["MIT-licensed"]),
    ("MIT", ["MIT-project"]),
    ("MIT", ["MIT-style"]),
    ("MIT", ["MIT-style-file"]),
    ("ISC", ["ISC-grant", "ISC-warranty", "ISC-liability"]),
    ("ISC", ["ISC-grant", "ISC-warranty"]),
    ("ISC", ["ISC-use", "ISC-warranty", "ISC-liability"]),
    ("ISC", ["ISC-use", "ISC-warranty"]),
    ("0BSD", ["0BSD-grant", "ISC-warranty", "ISC-liability"]),
    ("0BSD", ["0BSD-grant", "ISC-warranty"]),
    ("ISC", ["ISC-licensed"]),
    ("BSD-4-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-advertise", "BSD-endorse-university"]),
    ("BSD-4-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-advertise", "BSD-endorse"]),
    ("BSD-4-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-advertise"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse-author"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse-university"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse-holders"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse-name"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("BSD-2-Clause", ["BSD-2-licensed"]),
    ("BSD-3-Clause", ["BSD-3-licensed"]),
    ("BSD", ["BSD-licensed"]),
    ("BSD", ["BSD-style"]),
    ("Apache-2.0", ["Apache-foundation", "Apache-asf", "Apache-comply", "Apache-asis"]),
    ("Apache-2.0", ["Apache-notice", "Apache-comply", "Apache-asis"]),
    ("Apache-2.0", ["Apache-licensed"]),
    ("Apache-2.0", ["Apache-project"]),
    ("Apache-2.0", ["Apache-released"]),
    ("GPL-3.0", ["GPL-preamble", "GPL-preamble-v3"]),
    ("GPL-2.0", ["GNU-verbatim", "GPL-preamble-v2"]),
    ("GPL-1.0-or-later", ["GPL-free", "GPL-terms", "GNU-or-later-1"]),
    ("GPL-2.0-or-later", ["GPL-free", "GPL-v2", "GPL-warranty"]),
    ("GPL-2.0-or-later", ["GPL-terms", "GNU-or-later-2", "GPL-warranty"]),
    ("GPL-2.0-or-later", ["GPL-terms", "GNU-or-later-2"]),
    ("GPL-2.0-only", ["GPL-terms", "GNU-only-2", "GPL-warranty"]),
    ("GPL-2.0-only", ["GPL-terms", "GNU-only-2"]),
    ("GPL-2.0-only", ["GPL-terms", "GNU-only-2-dated"]),
    ("GPL-2.0-only", ["GPL-terms-v2"]),
    ("GPL-2.0-only", ["GPL-terms-only-v2"]),
    ("GPL-3.0-or-later", ["GPL-free", "GPL-v3", "GPL-warranty"]),
    ("GPL-3.0-or-later", ["GPL-terms", "GNU-or-later-3", "GPL-warranty"]),
    ("GPL-3.0-or-later", ["GPL-terms", "GNU-or-later-3"]),
    ("GPL-3.0-only", ["GPL-terms", "GNU-only-3"]),
    ("GPL-3.0-only", ["GPL-terms-v3"]),
    ("GPL-3.0-only", ["GPL-terms-only-v3"]),
    ("GPL-2.0-or-later", ["GPL-v2"]),
    ("GPL-3.0-or-later", ["GPL-v3"]),
    ("GPL-3.0", ["GPL-work-v3"]),
    ("GPL-3.0", ["GPL-project-v3"]),
    ("GPL-3.0", ["GPL-licensed-v3"]),
    ("GPL-2.0", ["GPL-project-v2"]),
    ("GPL-2.0", ["GPL-licensed-v2"]),
    ("LGPL-2.0-or-later", ["LGPL-terms-library", "GNU-or-later-2"]),
    ("LGPL-2.1-or-later", ["LGPL-terms", "GNU-or-later-2.1", "LGPL-warranty"]),
    ("LGPL-2.1-or-later", ["LGPL-terms", "GNU-or-later-2.1"]),
    ("LGPL-2.1-or-later", ["LGPL-v2.1"]),
    ("LGPL-3.0-or-later", ["LGPL-terms", "GNU-or-later-3"]),
    ("LGPL-3.0-or-later", ["LGPL-v3"]),
    ("LGPL-3.0", ["LGPL-incorporates"]),
    ("LGPL-3.0", ["LGPL-licensed"]),
    ("AGPL-3.0", ["AGPL-preamble", "GPL-preamble-v3"]),
    ("AGPL-3.0-or-later", ["GPL-free", "AGPL-v3", "GPL-warranty"]),
    ("AGPL-3.0-or-later", ["AGPL-v3"]),
    ("AGPL-3.0-only", ["AGPL-terms-v3"]),
    ("AGPL-3.0", ["AGPL-licensed"]),
    ("AGPL-3.0", ["AGPL-project"]),
    ("GFDL-1.3-or-later", ["FDL-permission"]),
    ("GFDL-1.2-or-later", ["FDL-permission-1.2"]),
    ("MPL-2.0-no-copyleft-exception", ["MPL-subject", "MPL-incompatible"]),
    ("MPL-2.0", ["MPL-subject"]),
    ("MPL-2.0", ["MPL-licensed"]),
    ("MPL-1.1", ["MPL-1.1-subject", "MPL-1.1-basis"]),
    ("EPL-1.0", ["EPL-1-available"]),
    ("EPL-2.0", ["EPL-2-available"]),
    ("EPL-2.0", ["EPL-2-available-v"]),
    ("CDDL-1.0", ["CDDL-subject"]),
    ("EUPL-1.2", ["EUPL-licensed", "EUPL-comply"]),
    ("Artistic-2.0", ["Artistic-terms"]),
    ("Artistic-2.0", ["Artistic-freedom", "Artistic-preamble"]),
    ("Perl", ["Perl-same"]),
    ("Zlib", ["zlib-provided", "zlib-liable", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-provided", "zlib-grant"]),
    ("BSL-1.0", ["BSL-grant", "BSL-notices"]),
    ("BSL-1.0", ["BSL-distributed"]),
    ("PostgreSQL", ["PostgreSQL-grant"]),
    ("HPND", ["HPND-grant"]),
    ("WTFPL", ["WTFPL-copy"]),
    ("OFL-1.1", ["OFL-grant", "OFL-sold"]),
    ("OFL-1.1", ["OFL-licensed"]),
    ("UPL-1.0", ["UPL-grant"]),
    ("CC-BY-4.0", ["CC-BY-work"]),
    ("CC-BY-4.0", ["CC-BY"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-work"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-work"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC"]),
    ("CC-BY-ND-4.0", ["CC-BY-ND-work"]),
    ("CC-BY-ND-4.0", ["CC-BY-ND"]),
    ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-work"]),
    ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA"]),
    ("CC-BY-NC-ND-4.0", ["CC-BY-NC-ND-work"]),
    ("CC-BY-NC-ND-4.0", ["CC-BY-NC-ND"]),
    ("CC-BY-3.0", ["CC-BY-3-work"]),
    ("CC-BY-SA-3.0", ["CC-BY-SA-3-work"]),
    ("CC-BY-SA", ["CC-text-available"]),
    ("CC0-1.0", ["CC0"]),
    ("CC0-1.0", ["CC0-dedicated"]),
    ("Unlicense", ["Unlicense"]),
    ("Apache-2.0 OR MIT", ["Dual-Apache-MIT"]),
    ("Apache-2.0 OR MIT", ["Dual-MIT-Apache"]),
    ("Apache-2.0 OR MIT", ["Dual-MIT-Apache-short"]),
    ("MIT", ["MIT-file"]),
    ("MIT", ["MIT-code"]),
]

# fixed values: licence expressions as files name them in one line
TAGS = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.1 Apache-2.0 GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 EUPL-1.2 "
    "Artistic-2.0 Zlib BSL-1.0 PostgreSQL WTFPL OFL-1.1 UPL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense GPL-2.0 GPL-2.0+ GPL-3.0 GPL-3.0+"
).split()
EXPRESSIONS = [
    *TAGS,
    "MIT OR Apache-2.0",
    "Apache-2.0 OR MIT",
    "GPL-2.0-only WITH Classpath-exception-2.0",
    "GPL-2.0-only WITH Linux-syscall-note",
    "GPL-2.0 WITH Linux-syscall-note",
    "GPL-2.0-or-later WITH Classpath-exception-2.0",
    "Apache-2.0 WITH LLVM-exception",
    "GPL-2.0-only OR BSD-3-Clause",
    "GPL-2.0-only OR MIT",
    "(GPL-2.0-only OR BSD-2-Clause)",
]
for _said in EXPRESSIONS:
    # "+" is no letter, so GPL-2.0+ reads as GPL-2.0: the same sentence, which names the licence alone
    if f"Tag-{_said.rstrip('+')}" not in SENTENCES:
        SENTENCES[f"Tag-{_said}"] = f"SPDX-License-Identifier {_said}"
        RULES.append((_said.strip("()"), [f"Tag-{_said}"]))

#: A sentence ends after these marks before white space or the end.
_END = r"([.!?;:]+)(\s+|$)"
_BREAK = "\x01"


def normal(sentence: str) -> str:
    """Lower-cased ASCII letters and digits, other runs as one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def cues(sentences: dict[str, str]) -> list[str]:
    """A few words of which every known sentence holds at least one."""
    left = {k: set(normal(v).split()) for k, v in sentences.items()}
    chosen: list[str] = []
    while left:
        words = sorted({w for ws in left.values() for w in ws if len(w) > 4 or not any(len(x) > 4 for x in ws)})
        best = max(words, key=lambda w: (sum(w in ws for ws in left.values()), len(w), w))
        chosen.append(best)
        left = {k: ws for k, ws in left.items() if best not in ws}
    return chosen


#: What is put right before a text is cut: the colon of a licence tag, which would end a sentence, and words that mark a comment line.
_BEFORE = [(r"(?i)(spdx-license-identifier):[ \t]*", "$1 "), (r"(?i)(^|\n)[ \t]*(dnl|rem)[ \t]+", "$1")]

#: A blank line, with or without comment marks.
_BLANK = r"(\r\n?|\n)([ \t\f\x0b]|[*#/;>|-])*(\r\n?|\n)\s*"


def _sentences(segment: Column) -> Column:
    """Array of the sentences of a text between marks: ``way``, ``part``, ``row``, ``said`` (normalised).

    ``part`` and ``row`` count the blank lines and the line breaks before it.
    """
    said = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    one = lambda way, part, row, s: F.struct(F.lit(way).alias("way"), part.alias("part"), row.alias("row"), said(s).alias("said"))
    parts = F.split(segment, _BLANK)
    rows = F.flatten(F.transform(parts, lambda p, j: F.transform(F.split(p, "[\n\r]+"), lambda r, k: one(0, j, k, r))))
    return F.concat(rows, F.array(one(1, F.lit(0), F.lit(0), segment)), F.transform(parts, lambda p, j: one(2, j, F.lit(0), p)))


def known_sentences(docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None) -> DataFrame:
    """``id``, ``way`` (0: by marks and lines, 1: by marks alone, 2: by marks and blank lines), ``at``, ``sentence`` of each known sentence.

    ``at`` (marks, blank lines and line breaks before it) has the same order in all ways.
    Texts without any cue word hold no known sentence and are not cut.  The
    table of sentences is fixed and small, and is the broadcast side.
    """
    sentences = SENTENCES if sentences is None else sentences
    table = docs.sparkSession.createDataFrame([(normal(v), k) for k, v in sentences.items()], "said string, sentence string")
    cue = F.col("text").rlike("(?i)" + "|".join(cues(sentences)))
    hits = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(cue)
    plain = F.col("text")
    for pattern, kept in _BEFORE:
        plain = F.regexp_replace(plain, pattern, kept)
    segments = hits.select("id", F.posexplode(F.split(F.regexp_replace(plain, _END, f"$1{_BREAK}"), _BREAK)).alias("segment", "text"))
    cut = segments.select("id", "segment", F.explode(_sentences(F.col("text"))).alias("s")).select("id", "s.way", F.struct("segment", "s.part", "s.row").alias("at"), "s.said")
    return cut.join(F.broadcast(table), "said").select(F.col("id").alias(id), "way", "at", "sentence")


def scan_licences(docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``id``, ``licence``, ``n_sentences``: one row for each licence of a document.

    The known sentences of a document, found by any way of cutting, are one
    sequence in the order of the text.  The rules are tried one after another:
    a rule that matches names its licence and takes the sentences it matched,
    as often as they follow one another, so no later rule is met by them.
    ``n_sentences`` is the number of known sentences of the document.  Rows
    with the same id are one document, in any order of the rows.  Null, empty
    and unlicensed texts and empty tables give no rows; very long texts are cut
    like others, as no step needs more than one text at a time.
    """
    rules = RULES if rules is None else rules
    found = known_sentences(docs, id, text, sentences)
    # one sentence may be found by several ways
    once = found.groupBy(id, F.col("at.segment").alias("segment"), "sentence").agg(F.min("at").alias("at"))
    runs = once.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("run"))
    said = F.array_join(F.transform("run", lambda r: F.concat(F.lit("<"), r["sentence"], F.lit(">"))), "")
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"<{ids[0]}>").alias("first"), F.lit(rule_pattern(ids)).alias("pattern"), F.lit("".join(f"${i}" for i in range(1, len(ids)))).alias("gaps")) for name, ids in rules])
    start = F.struct(said.alias("left"), F.array().cast("array<string>").alias("names"))

    def take(state: Column, rule: Column) -> Column:
        taken = F.struct(F.regexp_replace(state["left"], rule["pattern"], rule["gaps"]).alias("left"), F.array_append(state["names"], rule["name"]).alias("names"))
        return F.when(F.contains(state["left"], rule["first"]) & F.rlike(state["left"], rule["pattern"]), taken).otherwise(state)

    named = F.aggregate(ordered, start, take, lambda state: F.array_distinct(state["names"]))
    return runs.select(id, F.explode(named).alias("licence"), F.size("run").cast("bigint").alias("n_sentences"))


def rule_pattern(ids: list[str]) -> str:
    """Pattern of a rule in a sequence ``<a><b><c>``; its groups are what lies between the sentences."""
    return "(.*?)".join(f"<{re.escape(i)}>" for i in ids)


def scan_sql() -> str:
    """DuckDB SQL for the rows of :func:`scan_licences` on ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    table = ", ".join(f"({quoted(normal(v))}, {quoted(k)})" for k, v in SENTENCES.items())
    plain = "text"
    for pattern, kept in _BEFORE:
        plain = f"regexp_replace({plain}, {quoted(pattern)}, {quoted(kept.replace('$', chr(92)))}, 'g')"
    end = f"regexp_replace({plain}, " + r"'([.!?;:]+)([ \t\n\r\f\v]+|$)', '\1' || chr(1), 'g')"
    steps = ["left0 as (select doc_id, n, said as s, [] as names from runs)"]
    for i, (name, ids) in enumerate(RULES):
        pattern, gaps = quoted(rule_pattern(ids).replace(r"\-", "-")), quoted("".join(f"\\{k}" for k in range(1, len(ids))))
        steps.append(f"left{i + 1} as (select doc_id, n, regexp_replace(s, {pattern}, {gaps}, 'g') as s, case when regexp_matches(s, {pattern}) then list_append(names, {quoted(name)}) else names end as names from left{i})")
    chain = ",\n    ".join(steps)
    return f"""
    with known(said, sentence) as (values {table}),
    segments as (select doc_id, unnest(range(len(s))) as segment, unnest(s) as t from (select doc_id, string_split({end}, chr(1)) as s from documents)),
    parts as (select doc_id, segment, unnest(range(len(s))) as part, unnest(s) as t from (select doc_id, segment, regexp_split_to_array(t, {quoted(_BLANK)}) as s from segments)),
    rows_ as (select doc_id, segment, part, unnest(range(len(s))) as line, unnest(s) as t from (select doc_id, segment, part, regexp_split_to_array(t, '[\n\r]+') as s from parts)),
    cut as (select doc_id, segment, 0 as part, 0 as line, t from segments union all select doc_id, segment, part, 0, t from parts union all select * from rows_),
    found as (select doc_id, segment, sentence, min((segment, part, line)) as place from cut join known on said = trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) group by doc_id, segment, sentence),
    runs as (select doc_id, count(*) as n, string_agg('<' || sentence || '>', '' order by place, sentence) as said from found group by doc_id),
    {chain}
    select doc_id, licence, n::bigint as n_sentences from (select doc_id, n, unnest(list_distinct(names)) as licence from left{len(RULES)})"""

"""Texts of common licences, short ones whole, long ones as far as their first 260 words; and the headers of source files."""

# The licences' own words.
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    ),
    (
        "BSD-3-Clause",
        """rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the University nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written permission. THIS
SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Apache-2.0",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION,
AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution
as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by
the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all
other entities that control, are controlled by, or are under common control with that entity. For the purposes of this
definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity,
whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii)
beneficial ownership of such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions
granted by this License. "Source" form shall mean the preferred form for making modifications, including but not
limited to software source code, documentation source, and configuration files. "Object" form shall mean any form
resulting from mechanical transformation or translation of a Source form, including but not limited to compiled object
code, generated documentation, and conversions to other media types. "Work" shall mean the work of authorship, whether
in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or
attached to the work (an example is provided in the Appendix below). "Derivative Works" shall mean any work, whether
in Source or Object form, that is based on""",
    ),
    (
        "GPL-3.0",
        """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of
works. The licenses for most software and other practical works are designed to take away your freedom to share and
change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and
change all versions of a program--to make sure it remains free software for all its users. We, the Free Software
Foundation, use the GNU General Public License for most of our software; it applies also to any other work released
this way by its authors. You can apply it to your programs, too. When we speak of free software, we are referring to
freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute
copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it,
that you can change the software or use pieces of it in new free programs, and that you know you can do these things.
To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights.
Therefore, you have certain responsibilities if you distribute copies of the software, or if you modify it:""",
    ),
    (
        "GPL-2.0",
        """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin
Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this
license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away
your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom
to share and change free software--to make sure the software is free for all its users. This General Public License
applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.
(Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can
apply it to your programs, too. When we speak of free software, we are referring to freedom, not price. Our General
Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge
for this service if you wish), that you receive source code or can get it if you want it, that you can change the
software or use pieces of it in new free programs; and that you know you can do these things. To protect your rights,
we need to make restrictions that forbid anyone to deny you these rights or to ask you to surrender the rights. These
restrictions translate to certain responsibilities for you if you distribute copies of the software, or if you""",
    ),
    (
        "LGPL-3.0",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of
version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional
Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU
GPL" refers to version 3 of the GNU General Public License. "The Library" refers to a covered work governed by this
License, other than an Application or a Combined Work as defined below. An "Application" is any work that makes use of
an interface provided by the Library, but which is not otherwise based on the Library. Defining a subclass of a class
defined by the Library is deemed a mode of using an interface provided by the Library. A "Combined Work" is a work
produced by combining or linking an Application with the Library. The particular version of the Library with which the
Combined Work was made is also called the "Linked Version". The "Minimal Corresponding Source" for a Combined Work
means the Corresponding Source for the Combined Work, excluding any source code for portions of the Combined Work
that, considered in isolation, are based on the Application, and not on the Linked Version. The "Corresponding
Application Code" for a Combined Work means the object code and/or source code for""",
    ),
    (
        "MPL-2.0",
        """Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1. "Contributor"
means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2.
"Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that
particular Contributor's Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4.
"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the
Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions
thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that the initial Contributor has attached the notice
described in Exhibit B to the Covered Software; or (b) that the Covered Software was made available under the terms of
version 1.1 or earlier of the License, but not also under the terms of a Secondary License. 1.6. "Executable Form"
means any form of the work other than Source Code Form. 1.7. "Larger Work" means a work that combines Covered Software
with other material, in a separate file or files, that is not Covered Software. 1.8. "License" means this document.
1.9. "Licensable" means having the right to grant, to the maximum extent possible, whether at the time of the initial
grant or subsequently, any and all of the rights conveyed by this License. 1.10. "Modifications" means any of the
following: (a) any file in Source Code Form that results from an addition to, deletion from, or modification of the
contents of Covered Software; or (b)""",
    ),
    (
        "AGPL-3.0",
        """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.
<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other
kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.
The licenses for most software and other practical works are designed to take away your freedom to share and change
the works. By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all
versions of a program--to make sure it remains free software for all its users. When we speak of free software, we are
referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to
distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if
you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do
these things. Developers that use our General Public Licenses protect your rights with two steps: (1) assert copyright
on the software, and (2) offer you this License which gives you legal permission to copy, distribute and/or modify the
software. A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the
program, if they receive widespread use, become available for other developers to incorporate.""",
    ),
)

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public
License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more
details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_REDISTRIBUTION = TEXTS[2][1].removeprefix("rights reserved. ")

# The headers that the licences' texts prescribe for source files, and short licences that stand there whole.
HEADERS: tuple[tuple[str, str], ...] = (
    ("GPL-3.0", _GPL.format("", 3)),
    ("GPL-2.0", _GPL.format("", 2)),
    ("LGPL-3.0", _GPL.format("Lesser ", 3)),
    ("AGPL-3.0", _GPL.format("Affero ", 3)),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    ),
    ("MIT", TEXTS[0][1]),
    ("ISC", TEXTS[1][1]),
    ("BSD-3-Clause", _REDISTRIBUTION),
)

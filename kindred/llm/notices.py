"""Licence notices and texts, and the key phrases that must stand in them.

Fixed values: public wordings, as their licences give them; names and years are left out.
"""

from __future__ import annotations

#: Base phrases and their labels: found wherever they stand whole.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

AS_IS = (
    'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
    "merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for "
    "any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with "
    "the software or the use or other dealings in the software."
)

BSD_OPENING = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)

BSD_ENDING = (
    'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not '
    "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the "
    "copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, "
    "but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused "
    "and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out "
    "of the use of this software, even if advised of the possibility of such damage."
)

#: By label: the wording and its mandatory phrases.
NOTICES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc0": ("to the extent possible under law the author has waived all copyright", ("waived all copyright",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee", ("with or without fee",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    # whole texts
    "apache-2.0-header": (
        'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may '
        "obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, "
        'software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or '
        "implied. see the license for the specific language governing permissions and limitations under the license.",
        ("except in compliance with the license",),
    ),
    "bsd-2-clause": (f"{BSD_OPENING} {BSD_ENDING}", ("documentation and or other materials provided with the distribution", "this software is provided by the copyright holders and contributors")),
    "bsd-3-clause": (
        f"{BSD_OPENING} 3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. {BSD_ENDING}",
        ("may be used to endorse or promote products derived from this software",),
    ),
    "gpl-header": (
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by "
        "the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the "
        "hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular "
        "purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with "
        "this program. if not, see https://www.gnu.org/licenses/.",
        ("terms of the gnu general public license as published by the free software foundation",),
    ),
    "isc-text": (
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all '
        "warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be "
        "liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this "
        "software.",
        ("the author disclaims all warranties with regard to this software",),
    ),
    "mit-whole": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the "
        "following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        f"software. {AS_IS}",
        ("shall be included in all copies or substantial portions of the software",),
    ),
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, "
        "you can obtain one at https://mozilla.org/mpl/2.0/.",
        ("if a copy of the mpl was not distributed with this file",),
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("anyone is free to copy modify publish use compile sell or distribute this software",),
    ),
    "zlib": (
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages "
        "arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. 2. altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. this notice may not be removed or altered from any source distribution.",
        ("altered source versions must be plainly marked as such",),
    ),
}

"""Licence wordings as templates.

``<<beginOptional>> .. <<endOptional>>`` may be absent; ``<<var;0,k>>`` stands
for up to ``k`` words of any kind; all other words must occur as they stand.
"""

# Public licence wordings and notices, label first.
TEMPLATES = (
    (
        "mit",
        "<<beginOptional>>Permission is hereby granted,<<endOptional>> free of charge, to any "
        "person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission "
        "notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included "
        "in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this "
        "software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: <<var;0,2>> Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. <<var;0,2>> Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "
        '"License"); you may not use this file except in compliance with the License'
        "<<endOptional>>",
    ),
    (
        "gpl-notice",
        "This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it "
        "and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> "
        "<<beginOptional>>Affero<<endOptional>> General Public License as published by the Free "
        "Software Foundation, either version <<var;1,2>> of the License, or "
        "<<beginOptional>>(at your option)<<endOptional>> any later version.",
    ),
    (
        "gpl-3.0",
        "<<beginOptional>>This work is<<endOptional>> licensed under the GNU General Public "
        "License, version 3",
    ),
    ("mit-notice", "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("cc-by-nc-4.0", "Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("proprietary", "All rights reserved"),
    (
        "copyright",
        "Copyright <<beginOptional>>(c)<<endOptional>> <<var;1,12>> all rights reserved",
    ),
)

# Phrases that are reported wherever their words stand together.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
